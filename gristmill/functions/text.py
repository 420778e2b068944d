"""Scalar functions on names, paths, addresses and routes, all as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File names that say test, by language.
TEST_FILE_PATTERN = r"Tests?\.java$|^test_.*\.py$|_test\.py$|\.test\.tsx?$|\.spec\.tsx?$"
# Names of store engines and what they are called here.
ENGINES = {
    "postgres": "postgresql", "postgresql": "postgresql", "mysql": "mysql", "mariadb": "mariadb", "mongo": "mongodb", "mongodb": "mongodb", "redis": "redis", "cassandra": "cassandra",
    "oracle": "oracle", "sqlserver": "sqlserver", "mssql": "sqlserver", "db2": "db2", "sqlite": "sqlite", "h2": "h2", "dynamodb": "dynamodb",
}
# Endings of environment keys that name another service, in order of preference.
ENV_SUFFIXES = ["_API_ADDR", "_ADDR", "_URI", "_URL", "_HOST"]
# Fixed value: a line that assigns something secret, as the evidence snippets redact it.
SECRET_ASSIGNMENT = r"""(?i)((?:password|passwd|secret|api[_-]?key|access[_-]?key|private[_-]?key|token|auth)\s*[:=]\s*)(['"]?)([^'",\s]+)(['"]?)"""

# The five patterns of the review's redaction, with what stands in their place.
FIVE_RULES = [
    (r"(AKIA)[0-9A-Z]{16}", "$1***REDACTED***"),
    (r"Bearer\s+[A-Za-z0-9\-_.]{20,}", "Bearer ***REDACTED***"),
    (r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----", "-----BEGIN PRIVATE KEY-----***REDACTED***-----END PRIVATE KEY-----"),
    (r"(://[^:/\s@]+:)([^@/\s]+)(@)", "$1***REDACTED***$3"),
    (r"""(?i)\b(password|pwd|secret)\s*=\s*['"]?([^\s'";]+)""", "$1=***REDACTED***"),
]


def basename(path: Column) -> Column:
    """Last segment of a path."""
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def is_test_path(path: Column) -> Column:
    """F-01: a segment is test, tests or __tests__, or the file name follows a test convention; null paths are none."""
    return F.coalesce(path.rlike(r"(?:^|[/\\])(?:test|tests|__tests__)(?:[/\\]|$)") | basename(path).rlike(TEST_FILE_PATTERN), F.lit(False))


def stem(path: Column) -> Column:
    """File name without its last extension."""
    return F.regexp_replace(basename(path), r"(.)\.[^.]*$", "$1")


def normal_name(c: Column) -> Column:
    """An identifier in lower case with letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def import_target(c: Column) -> Column:
    """The form in which an import target is referred to: no leading @, and _ for / . and -."""
    return F.concat(F.lit("ref_"), F.regexp_replace(F.regexp_replace(c, "^@", ""), r"[/.\-]", "_"))


def jdbc_literal(c: Column) -> Column:
    """F-17: the default of ``${NAME:jdbc:...}`` if it is a jdbc address and no placeholder is nested; else the text itself."""
    default = F.regexp_extract(c, r"^\$\{[^:{}$]*:((?i:jdbc:[a-z0-9+]+:)[^\n]*)\}$", 1)
    return F.when(c.startswith("${") & c.endswith("}") & ~F.substring(c, 3, 1 << 20).contains("${") & (default != ""), default).otherwise(c)


def jdbc_scheme(c: Column) -> Column:
    """F-17: the scheme behind ``jdbc:`` in lower case, null if there is none."""
    s = F.lower(F.regexp_extract(jdbc_literal(c), r"(?i)^jdbc:([a-z0-9+]+):", 1))
    return F.when(s != "", s)


def known_engine(token: Column) -> Column:
    """The engine a name stands for; null if it is not known."""
    return F.create_map(*[F.lit(x) for kv in ENGINES.items() for x in kv])[F.lower(token)]


def image_engine(image: Column) -> Column:
    """F-18: the engine of a container image: the first known segment, less the tag behind the last slash."""
    path = F.regexp_replace(image, r":[^/]*$", "")
    return F.get(F.filter(F.transform(F.split(path, "/"), known_engine), lambda x: x.isNotNull()), F.lit(0))


def value_host(value: Column) -> Column:
    """S-15: the host in a configuration value, from an address without its credentials or from host:port; else null. The value itself is never passed on."""
    uri = F.regexp_extract(value, r"://(?:[^@/]*@)?([^:/?#]+)", 1)
    plain = F.regexp_extract(value, r"^([a-zA-Z0-9.\-]+):\d+$", 1)
    return F.when(value.contains("://") & (uri != ""), uri).when(plain != "", plain)


def env_service(key: Column) -> Column:
    """F-10: the service that an environment key names: the first allowed ending that fits is cut off; null if none does."""
    up = F.upper(key)
    out = F.lit(None).cast("string")
    for suffix in reversed(ENV_SUFFIXES):
        out = F.when(up.endswith(suffix) & (F.length(key) > len(suffix)), F.substring(key, F.lit(1), F.length(key) - len(suffix))).otherwise(out)
    return out


def route_key(route: Column) -> Column:
    """J-13: a route for comparison: parameters of any spelling become {PARAM}, all in upper case."""
    return F.upper(F.regexp_replace(route, r":[A-Za-z_]\w*|\{[^}]*\}|<[^>]*>", "{PARAM}"))


def interface_key(route: Column) -> Column:
    """A route for scoring: slashes not doubled, none at the end, parameters as {x}."""
    one = F.regexp_replace(F.regexp_replace(route, r"/{2,}", "/"), r"(.)/$", "$1")
    return F.regexp_replace(one, r":([A-Za-z_]\w*)|<([^>]*)>", "{$1$2}")


def redact_assignment(c: Column) -> Column:
    """The value of a secret assignment replaced, the rest of the line kept."""
    return F.regexp_replace(c, SECRET_ASSIGNMENT, "$1$2[REDACTED]$4")


def relationship_id(kind: Column, source: Column, target: Column, mechanism: Column, engine: Column) -> Column:
    """An id made of what a relationship says: kind|from|to|mechanism, or the engine where there is no mechanism."""
    return F.concat_ws("|", kind, source, target, F.coalesce(mechanism, engine))


def redact_five(c: Column) -> Column:
    """The five rules of the review, one after the other: access keys, bearer tokens, private key blocks, passwords in addresses and assigned ones."""
    for pattern, new in FIVE_RULES:
        c = F.regexp_replace(c, pattern, new)
    return c
