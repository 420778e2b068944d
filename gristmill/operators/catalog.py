"""Rule catalogues and lookup tables as data. All are fixed and small, so frames of them may be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Signal rules in catalogue order (id, language, source, signals, category, weight).
SIGNAL_RULES = [
    ("flask-route", "python", "native-route", "app.route", "http-entry-point", 40),
    ("fastapi-route", "python", "native-route", "router", "http-entry-point", 40),
    ("nestjs-route", "typescript", "native-route", "get|post|put|patch|delete", "http-entry-point", 40),
    ("flask-route-decorator", "python", "decorator", "route", "http-entry-point", 40),
    ("fastapi-verb-decorator", "python", "decorator", "get|post|put|patch|delete", "http-entry-point", 40),
    ("nestjs-controller-decorator", "typescript", "decorator", "Controller", "framework-bootstrap", 25),
    ("nestjs-graphql-resolver-decorator", "typescript", "decorator", "Resolver", "framework-bootstrap", 25),
    ("nestjs-verb-decorator", "typescript", "decorator", "Get|Post|Put|Patch|Delete", "http-entry-point", 40),
    ("flask-bootstrap", "python", "decorator", "Flask", "framework-bootstrap", 25),
    ("fastapi-bootstrap", "python", "decorator", "FastAPI", "framework-bootstrap", 25),
    ("jax-rs-composed-route", "java", "decorator", "GET|POST|PUT|DELETE|PATCH", "http-entry-point", 40),
    ("jpa-entity", "java", "decorator", "Entity", "persistence", 40),
    ("jpa-table", "java", "decorator", "Table", "persistence", 10),
    ("spring-service-stereotype", "java", "decorator", "Service", "framework-bootstrap", 40),
    ("spring-mvc-controller-decorator", "java", "decorator", "RestController|Controller", "framework-bootstrap", 25),
    ("spring-preauthorize", "java", "decorator", "PreAuthorize", "security-control", 40),
    ("java-call-site-permission-check", "java", "call", "validateHasReadPermission|validateHasPermission|validateHasCheckerPermission", "security-control", 40),
    ("java-user-role-service-check", "java", "call", "hasRole", "security-control", 40),
    ("java-call-site-authenticated-check", "java", "call", "isAuthenticated", "security-control", 30),
    ("python-jwt-decode-call", "python", "call", "jwt.decode", "security-control", 20),
    ("kafka-listener", "java", "decorator", "KafkaListener", "messaging", 40),
    ("jms-listener", "java", "decorator", "JmsListener", "messaging", 40),
    ("spring-data-repository-extends", "java", "extends", "JpaRepository|CrudRepository|PagingAndSortingRepository|JpaSpecificationExecutor", "persistence", 40),
    ("lambda-request-handler-implements", "java", "extends", "RequestHandler|RequestStreamHandler", "serverless-entry-point", 40),
    ("kafka-template-field", "java", "field-type", "KafkaTemplate", "messaging", 40),
    ("spring-retryable", "java", "decorator", "Retryable", "resilience", 40),
    ("resilience4j-retry", "java", "decorator", "Retry", "resilience", 40),
]
# Confidence of a resolved edge by mechanism, in one root and across roots.
TRUST = {
    "r2-phase1": (15, 10), "r2-stereotype": (12, 7), "r2b": (8, 5), "r2c": (6, 3), "admitted-unresolved": (3, 2),
    "codeql-di-stereotype": (7, 4), "codeql-di-bean-factory": (7, 4), "codeql-command-dispatch": (7, 4),
}
# Sources of interface evidence, best first.
INTERFACE_PRECEDENCE = ["native-route", "openapi", "structured-file", "decorator"]
# Packages whose import makes a store, by language.
STORE_LIBRARIES = {
    "python": ["sqlalchemy", "psycopg2", "pymongo", "redis", "sqlite3", "mysql", "mysqlclient", "pymysql"],
    "typescript": ["typeorm", "prisma", "@prisma/client", "mongoose", "sequelize", "pg", "mysql2", "ioredis", "@aws-sdk/client-dynamodb", "aws-sdk"],
    "java": ["com.mongodb", "com.amazonaws.services.dynamodbv2", "software.amazon.awssdk.services.dynamodb", "org.postgresql", "org.jooq", "org.springframework.jdbc.core"],
}
# Owner of a driver: base class or type of a field that a class must have to count as using it, by library.
OWNER_BASES = {"@prisma/client": "PrismaClient"}
OWNER_FIELDS = {"@aws-sdk/client-dynamodb": "DynamoDBClient", "com.amazonaws.services.dynamodbv2": "AmazonDynamoDB", "software.amazon.awssdk.services.dynamodb": "DynamoDbClient"}
# Annotations of classes that only wire others, libraries of HTTP clients and of queues.
WIRING = ["Configuration"]
HTTP_CLIENTS = {"python": ["requests", "httpx"], "java": ["org.springframework.web.client.RestTemplate", "org.springframework.web.reactive.function.client.WebClient", "okhttp3.OkHttpClient", "java.net.HttpURLConnection"], "typescript": ["axios", "node-fetch"]}
QUEUE_LIBRARIES = {"typescript": ["@aws-sdk/client-sqs", "@aws-sdk/client-sns", "aws-sdk"]}
# Controls in catalogue order (id, language, signal).
CONTROLS = [
    ("security-rbac-001", "java", "PreAuthorize"), ("security-rbac-002", "java", "validateHasReadPermission|validateHasPermission|validateHasCheckerPermission"), ("security-rbac-003", "java", "hasRole"),
    ("security-auth-002", "java", "isAuthenticated"), ("security-auth-001", "python", "jwt.decode"), ("security-contract-http-bearer-001", "any", "http-bearer"), ("security-contract-http-basic-001", "any", "http-basic"),
    ("security-contract-apikey-001", "any", "apiKey"), ("security-contract-oauth2-001", "any", "oauth2"),
]
# Node type of a unit kind.
NODE_TYPES = {"service": "service", "database": "database", "topic": "network", "unresolved": "unresolved-endpoint"}
FLOOR, HIGH, MEDIUM = 40, 70, 40


def signal_rules(spark: SparkSession) -> DataFrame:
    """One row for each signal of each rule: (rule_ord, rule_id, rule_language, rule_source, signal, pattern, category, weight)."""
    import re

    rows = [(i, r[0], r[1], r[2], s, rf"(?i)\b{re.escape(s)}\b", r[4], r[5]) for i, r in enumerate(SIGNAL_RULES) for s in r[3].split("|")]
    return spark.createDataFrame(rows, "rule_ord int, rule_id string, rule_language string, rule_source string, signal string, pattern string, category string, weight int")


def trust_table(spark: SparkSession) -> DataFrame:
    """(mechanism, scope, confidence)."""
    return spark.createDataFrame([(m, s, c) for m, pair in TRUST.items() for s, c in zip(("same-root", "cross-root"), pair, strict=True)], "mechanism string, scope string, confidence int")


def with_trust(edges: DataFrame, spark: SparkSession) -> DataFrame:
    """``edges`` (mechanism, cross) with ``confidence`` of their tier. A mechanism without tier is an error, never a default."""
    scope = F.when(F.col("cross"), "cross-root").otherwise("same-root")
    joined = edges.withColumn("scope", scope).join(F.broadcast(trust_table(spark)), ["mechanism", "scope"], "left")
    checked = F.when(F.col("confidence").isNull(), F.raise_error(F.concat(F.lit("no trust tier for "), F.col("mechanism"), F.lit("/"), F.col("scope"))).cast("int")).otherwise(F.col("confidence"))
    return joined.withColumn("confidence", checked)


def controls(spark: SparkSession) -> DataFrame:
    """(control_ord, control_id, control_language, control_signal)."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(CONTROLS)], "control_ord int, control_id string, control_language string, control_signal string")
