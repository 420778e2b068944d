"""Deployments, contracts and configuration joined to units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import env_service, image_engine, jdbc_scheme, known_engine, normal_name, route_key, stem
from gristmill.operators.correlate import contained_name, ranked_tier_join, shared_secret_edges
from gristmill.operators.evidence import exactly_one, first_wins


def deployment_units(deployments: DataFrame, units: DataFrame) -> DataFrame:
    """J-15: (name, unit_id): the service unit of each deployment, by equal or contained base name; of several deployments the first by name. ``units`` (unit_id, file, kind, unit_ord)."""
    names = deployments.select("name", F.col("name").alias("o")).distinct()
    service = units.where("kind = 'service'").withColumn("base", stem(F.col("file")))
    hit = contained_name(service, "base", names.select(F.col("name").alias("m"), F.col("o")), "m", "o").where("match is not null")
    far = normal_name(F.col("base")) != normal_name(F.col("match"))
    return hit.groupBy(F.col("match").alias("name")).agg(F.min_by("unit_id", F.struct(far, "unit_ord")).alias("unit_id"))


def trust_edges(deployments: DataFrame) -> DataFrame:
    """J-16: (from_name, to_name): who verifies what who issues; a mount with a key that is not public makes an issuer, and one edge counts for a pair."""
    m = deployments.select("name", F.explode("secret_mounts").alias("s")).select(F.col("s.secret_name").alias("secret"), F.col("name").alias("member"), F.exists("s.item_keys", lambda k: ~k.rlike("(?i)pub")).alias("is_issuer"))
    return shared_secret_edges(m).select(F.col("verifier").alias("from_name"), F.col("issuer").alias("to_name")).distinct()


def placement_edges(deployments: DataFrame, matched: DataFrame) -> DataFrame:
    """J-17: (unit_id, namespace node) of every matched deployment."""
    return deployments.join(matched, "name").select("unit_id", F.concat(F.lit("k8s-namespace:"), "namespace").alias("node")).distinct()


def env_edges(deployments: DataFrame, config_keys: DataFrame, matched: DataFrame) -> DataFrame:
    """J-18: (from_name, key, to_name, outcome) of configuration keys that name another deployment.

    Of names that fit the first counts, an equal one before others. outcome is edge if both deployments have units, database if the target is a known engine, candidate if only the value's host is one, else unresolved. Nothing is guessed.
    """
    refs = deployments.select("name", F.explode("config_map_names").alias("config_map")).join(config_keys, "config_map").withColumn("service", env_service(F.col("key"))).where("service is not null")
    d = deployments.select(F.col("name").alias("m"), F.col("name").alias("o")).distinct()
    near = contained_name(refs, "service", d, "m", "o").withColumn("match", F.when(F.col("match") != F.col("name"), F.col("match")))
    host = deployments.groupBy(normal_name(F.col("name")).alias("_h")).agg(F.min("name").alias("host_match"))
    j = near.withColumn("_h", normal_name(F.col("host"))).join(host, "_h", "left")
    eng = deployments.groupBy(F.col("name").alias("match")).agg(F.min(F.coalesce(image_engine(F.col("image")), known_engine(F.col("container_name")))).alias("engine"))
    u = matched.select("name", F.lit(True).alias("has_from"))
    v = matched.select(F.col("name").alias("match"), F.lit(True).alias("has_to"))
    k = j.join(eng, "match", "left").join(u, "name", "left").join(v, "match", "left")
    outcome = F.when(F.col("match").isNotNull() & F.col("has_from") & F.col("has_to"), "edge").when(F.col("match").isNotNull() & F.col("has_from") & F.col("engine").isNotNull(), "database").when(F.col("match").isNull() & F.col("host_match").isNotNull() & (F.col("host_match") != F.col("name")), "candidate").otherwise("unresolved")
    return k.select(F.col("name").alias("from_name"), "key", F.coalesce("match", F.when(F.col("host_match") != F.col("name"), F.col("host_match"))).alias("to_name"), outcome.alias("outcome")).distinct()


def openapi_overlap(operations: DataFrame, routes: DataFrame) -> DataFrame:
    """J-13: (root, file, unit_id, outcome) of interface documents: attached to the one unit that shares a route, else a unit of their own. ``routes`` (root, unit_id, route "GET /x")."""
    op = operations.select("root", "file", route_key(F.concat_ws(" ", "method", "path")).alias("k")).distinct()
    hit = op.join(routes.select("root", "unit_id", route_key(F.col("route")).alias("k")).distinct(), ["root", "k"], "left")
    gate = exactly_one(hit, ["root", "file"], "unit_id")
    return gate.select("root", "file", "unit_id", F.when(F.col("outcome") == "resolved", "attached").otherwise("standalone").alias("outcome"))


def cfn_handlers(routes: DataFrame, units: DataFrame) -> DataFrame:
    """J-14: (path, method, unit_id, outcome): routes of templates at the one unit whose file is the handler's class."""
    cls = F.regexp_extract(F.substring_index("handler", "::", 1), r"([^.]+)$", 1)
    gate = exactly_one(routes.withColumn("cls", cls).join(units.select("unit_id", stem(F.col("file")).alias("cls")), "cls", "left"), ["path", "method"], "unit_id")
    return gate.select("path", "method", "unit_id", "outcome")


def sbom_corroboration(components: DataFrame, stores: DataFrame, units: DataFrame) -> DataFrame:
    """J-23: (root, outcome, library): per root, one store library with one store unit corroborates it, with none introduces one, anything else is ambiguous. ``stores`` (library)."""
    lib = components.join(stores.select(F.col("library").alias("name")).distinct(), "name", "left_semi")
    n = lib.groupBy("root").agg(F.count_distinct("name").alias("n_lib"), F.min("name").alias("library"))
    k = units.where("kind = 'database'").groupBy("root").agg(F.count("*").alias("n_unit"))
    u = F.coalesce("n_unit", F.lit(0))
    out = F.when((F.col("n_lib") == 1) & (u == 0), "introduced").when((F.col("n_lib") == 1) & (u == 1), "corroborated").otherwise("ambiguous")
    return n.join(k, "root", "left").select("root", out.alias("outcome"), F.when(F.col("n_lib") == 1, F.col("library")).alias("library"))


def cross_repo_edges(roots: DataFrame, contracts: DataFrame) -> DataFrame:
    """J-20: (root, node_id, tier): roots (root, api_title, coordinate, service) that use a published contract: by interface title, else by artifact, else by service name."""
    tiers = [(F.col("api_title"), F.col("c_api")), (F.col("coordinate"), F.col("c_artifact")), (F.col("service"), F.col("c_svc"))]
    c = contracts.select("node_id", F.col("api_title").alias("c_api"), F.col("artifact").alias("c_artifact"), F.coalesce("svc_name", "svc_dns").alias("c_svc"))
    return ranked_tier_join(roots, c, "root", "node_id", tiers)


def spring_units(properties: DataFrame) -> DataFrame:
    """F-21: (root, file, unit_id, kind, weight, argument) of configured stores and brokers, in every file and profile."""
    v = lambda k: F.max(F.when(F.col("key") == k, F.col("value")))
    g = properties.groupBy("root", "file", F.coalesce("doc_profile", "profile").alias("profile")).agg(
        F.coalesce(v("spring.datasource.url"), v("spring.datasource.hikari.jdbc-url"), v("spring.datasource.hikari.jdbcUrl")).alias("datasource"), v("spring.kafka.bootstrap-servers").alias("kafka"),
        F.coalesce(v("spring.rabbitmq.addresses"), F.concat_ws(":", v("spring.rabbitmq.host"), F.when(v("spring.rabbitmq.host").isNotNull(), F.coalesce(v("spring.rabbitmq.port"), F.lit("5672"))))).alias("rabbit"),
        v("spring.activemq.broker-url").alias("activemq"), F.coalesce(v("spring.data.redis.host"), v("spring.redis.host")).alias("_rh"), F.coalesce(v("spring.data.redis.port"), v("spring.redis.port"), F.lit("6379")).alias("_rp"),
    )
    g = g.withColumn("redis", F.when(F.col("_rh").isNotNull(), F.concat_ws(":", "_rh", "_rp")))
    names = [("datasource", "database"), ("redis", "database"), ("kafka", "topic"), ("rabbit", "topic"), ("activemq", "topic")]
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("suffix"), F.lit(k).alias("kind"), F.col(n).alias("argument")) for n, k in names))).alias("u")
    unit = F.concat(F.col("file"), F.when(F.col("profile").isNotNull(), F.concat(F.lit("#"), "profile")).otherwise(""), F.lit("::"), F.col("suffix"))
    return g.select("root", "file", "profile", rows).select("root", "file", "profile", "u.*").where("argument is not null and argument <> ''").select("root", "file", unit.alias("unit_id"), "kind", F.lit(40).alias("weight"), "argument", jdbc_scheme(F.col("argument")).alias("scheme"))


def bind_edges(bindings: DataFrame, units: DataFrame, existing: DataFrame, confidence: Column) -> tuple[DataFrame, DataFrame]:
    """J-21: (edges, introduced units) of ``bindings`` (root, from_file, to_file, ord): the source must have a unit, a target without one is introduced, and a pair that has an edge already is left alone."""
    u = units.groupBy("root", "file").agg(F.min("unit_id").alias("unit_id"))
    a = bindings.join(u.select("root", F.col("file").alias("from_file"), F.col("unit_id").alias("from_id")), ["root", "from_file"])
    b = a.join(u.select("root", F.col("file").alias("to_file"), F.col("unit_id").alias("_t")), ["root", "to_file"], "left").withColumn("to_id", F.coalesce("_t", "to_file"))
    new = b.where("_t is null").select("root", F.col("to_file").alias("file"), F.col("to_id").alias("unit_id"), F.lit(10).alias("confidence")).distinct()
    edges = first_wins(b.select("from_id", "to_id", "ord", "root"), ["from_id", "to_id"], ["ord"]).where("from_id <> to_id").join(existing.select("from_id", "to_id").distinct(), ["from_id", "to_id"], "left_anti").withColumn("confidence", confidence)
    return edges, new


def enrich_tables(units: DataFrame, bindings: DataFrame) -> DataFrame:
    """J-22: ``units`` (root, file, kind, confidence) of databases with ten points for each distinct table named in ``bindings`` (root, file, table), a hundred at most."""
    t = bindings.where("table is not null and table <> ''").groupBy("root", "file").agg(F.count_distinct("table").alias("_n"))
    more = F.when(F.col("kind") == "database", F.least(F.lit(100), F.col("confidence") + 10 * F.coalesce("_n", F.lit(0)))).otherwise(F.col("confidence"))
    return units.join(t, ["root", "file"], "left").withColumn("confidence", more).drop("_n")


def replace_weak(units: DataFrame, evidence: DataFrame, stronger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J-11: (units, evidence) after ``stronger`` units (root, file, unit_id) took over the evidence of a stereotype-only service of their file, which goes."""
    weak = evidence.groupBy("root", "file", "unit_id").agg(F.bool_and(F.col("category") == "framework-bootstrap").alias("only")).where("only").select("root", "file", F.col("unit_id").alias("old"))
    moved = weak.join(stronger, ["root", "file"]).where("old <> unit_id").select("old", F.col("unit_id").alias("new"))
    kept = units.join(moved.select(F.col("old").alias("unit_id")), "unit_id", "left_anti")
    return kept, evidence.join(moved.withColumnRenamed("old", "unit_id"), "unit_id", "left").withColumn("unit_id", F.coalesce("new", "unit_id")).drop("new")
