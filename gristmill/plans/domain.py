"""Queries of the domain operators: coverage and review, sources, joins, documents. Each calls the operator itself over views of the tables at hand (``adapters``)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import catalog, coverage, deploy, evidence, relations, review
from gristmill.plans import adapters as ad
from gristmill.plans.pipeline import _NATIVE, _facts, query
from gristmill.session import checkpointed, table
from gristmill.sources import manifests, trees

# ---------------------------------------------------------------- coverage and review

_COMPLETE = (
    "WITH "
    + ad.RUNS_SQL
    + """, own AS (SELECT run, count(*) FILTER (kind = 'service') AS services, count(*) FILTER (kind = 'database') AS databases, count(*) FILTER (kind = 'topic') AS topics, count(*) FILTER (has_http AND NOT has_control) AS http_without_control,
  count(*) FILTER (kind = 'topic' AND has_messaging) AS messaging_unverified FROM un GROUP BY run),
sv AS (SELECT run, unit_id FROM un WHERE kind = 'service'), en AS (SELECT run, from_id AS unit_id FROM rel UNION SELECT run, to_id FROM rel),
tc AS (SELECT rel.run, count(*) AS n FROM rel LEFT JOIN sv a ON a.run = rel.run AND a.unit_id = from_id LEFT JOIN sv b ON b.run = rel.run AND b.unit_id = to_id WHERE a.unit_id IS NOT NULL OR b.unit_id IS NOT NULL GROUP BY rel.run),
iso AS (SELECT un.run, count(*) AS n FROM un LEFT JOIN en ON en.run = un.run AND en.unit_id = un.unit_id WHERE en.unit_id IS NULL GROUP BY un.run),
ou AS (SELECT sv.run, count(DISTINCT sv.unit_id) AS n FROM sv JOIN rel ON rel.run = sv.run AND rel.from_id = sv.unit_id WHERE grade = 'architecture' GROUP BY sv.run),
comp AS (SELECT own.run, services, databases, topics, coalesce(tc.n, 0) AS service_touching, http_without_control, messaging_unverified, coalesce(iso.n, 0) AS isolated, CASE WHEN databases + topics >= 1 THEN coalesce(ou.n, 0) ELSE 0 END AS services_outbound,
  CASE WHEN databases + topics >= 1 AND services > 0 THEN coalesce(ou.n, 0) / services END AS outbound_coverage FROM own LEFT JOIN tc ON tc.run = own.run LEFT JOIN iso ON iso.run = own.run LEFT JOIN ou ON ou.run = own.run),
fl AS (SELECT run, flag, n FROM (
  SELECT run, 'S0-cross-package-backbone-incomplete' AS flag, 1 AS n, cross_package_status <> 'ok' AS y FROM n
  UNION ALL SELECT run, 'S1-zero-service-touching-relationships', services, services >= 1 AND databases >= 1 AND service_touching = 0 FROM comp
  UNION ALL SELECT run, 'S2-http-without-security-control', http_without_control, http_without_control > 0 FROM comp
  UNION ALL SELECT run, 'S3-messaging-producer-unverified', messaging_unverified, messaging_unverified > 0 FROM comp
  UNION ALL SELECT run, 'S5-zero-service-units-with-store-present', databases + topics, services = 0 AND databases + topics >= 1 FROM comp
  UNION ALL SELECT run, 'S5-cfn-routes-found-but-unbound', cfn_found, cfn_found > 0 AND cfn_bound = 0 FROM n
  UNION ALL SELECT run, 'S6-isolated-nodes', isolated, isolated > 0 FROM comp) WHERE y)"""
)


def _run(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Units, relationships and completeness of all runs; each is read many times, so it is worked out once."""
    u, rel = checkpointed(ad.run_units(spark, d)), checkpointed(ad.run_relationships(spark, d))
    return u, rel, checkpointed(coverage.completeness(u, rel))


@query(_COMPLETE + " SELECT run, services, databases, topics, service_touching, http_without_control, messaging_unverified, isolated, services_outbound, round(outbound_coverage, 6) AS outbound_coverage FROM comp")
def completeness(spark: SparkSession, d: str) -> DataFrame:
    """A-05: what each run has, and what it lacks."""
    return _run(spark, d)[2].withColumn("outbound_coverage", F.round("outbound_coverage", 6))


@query(_COMPLETE + " SELECT run, flag, CAST(n AS BIGINT) AS n FROM fl")
def silence_flags(spark: SparkSession, d: str) -> DataFrame:
    """A-06: all seven flags, one row for each that holds."""
    return coverage.silence_flags(_run(spark, d)[2], ad.runs(spark, d))


@query(_COMPLETE + ", " + ad.IGNORED_SQL + """, hop AS (SELECT run, regexp_extract(detail, '^unresolved-multi-hop: "([^"]*)"', 1) AS unit_id, arg_min(detail, (ref, detail)) AS detail FROM ig WHERE reason = 'CROSS_DOMAIN_UNRESOLVED' AND detail LIKE 'unresolved-multi-hop: "%' GROUP BY ALL),
kn AS (SELECT run, unit_id, min(kind) AS kind, min(confidence) AS confidence FROM un GROUP BY ALL), bf AS (SELECT run, file, min(unit_id) AS unit_id FROM un GROUP BY ALL),
ul AS (SELECT ig.*, regexp_replace(ref, ':[0-9]+$', '') AS file FROM ig),
q AS (
  SELECT un.run, 'S1-zero-service-touching-relationships' AS trigger, un.unit_id, hop.detail FROM un LEFT JOIN hop ON hop.run = un.run AND hop.unit_id = un.unit_id WHERE kind IN ('service', 'database') AND un.run IN (SELECT run FROM fl WHERE flag LIKE 'S1-%')
  UNION ALL SELECT run, 'low-architecture-coverage', unit_id, NULL FROM un WHERE kind = 'service' AND run IN (SELECT run FROM comp WHERE outbound_coverage < 0.5) AND run NOT IN (SELECT run FROM fl WHERE flag LIKE 'S1-%') AND NOT EXISTS (SELECT 1 FROM rel WHERE rel.run = un.run AND rel.from_id = un.unit_id AND grade = 'architecture')
  UNION ALL SELECT run, 'S5-zero-service-units-with-store-present', unit_id, NULL FROM un WHERE kind IN ('database', 'topic') AND run IN (SELECT run FROM fl WHERE flag LIKE 'S5-zero%')
  UNION ALL SELECT run, 'S2-http-without-security-control', unit_id, NULL FROM un WHERE has_http AND NOT has_control
  UNION ALL SELECT run, 'S3-messaging-producer-unverified', unit_id, NULL FROM un WHERE kind = 'topic' AND has_messaging
  UNION ALL SELECT run, 'multi-hop-single-candidate-below-threshold', regexp_extract(detail, '^tier-b-single-candidate: "([^"]*)"', 1), detail FROM ig WHERE reason = 'CROSS_DOMAIN_UNRESOLVED' AND detail LIKE 'tier-b-single-candidate: "%'
  UNION ALL SELECT ul.run, 'unresolved-outbound-target', bf.unit_id, detail FROM ul LEFT JOIN bf ON bf.run = ul.run AND bf.file = ul.file WHERE reason = 'CROSS_DOMAIN_UNRESOLVED' AND detail LIKE 'unresolved-http-target:%'
  UNION ALL SELECT ul.run, 'unresolved-outbound-target', dep.unit_id, detail FROM ul LEFT JOIN dep ON dep.run = ul.run AND dep.name = regexp_extract(detail, '"([^"]+)"', 1) WHERE reason = 'CROSS_DOMAIN_UNRESOLVED' AND detail LIKE 'unresolved-env-target:%'
  UNION ALL SELECT ul.run, 'hand-rolled-resilience-candidate', bf.unit_id, detail FROM ul LEFT JOIN bf ON bf.run = ul.run AND bf.file = ul.file WHERE reason = 'INSUFFICIENT_EVIDENCE' AND detail LIKE 'hand-rolled-resilience-candidate:%'
  UNION ALL SELECT run, 'low-confidence-emitted-relationship', from_id, id FROM rel WHERE grade = 'architecture' AND confidence < 40
  UNION ALL SELECT run, 'contradicting-evidence-force-review', ref, detail FROM ig WHERE reason = 'AMBIGUOUS_BOUNDARY' AND detail LIKE 'contradiction: %'),
cf AS (SELECT run, list_sort(list(detail)) AS l FROM ig WHERE detail LIKE 'unresolved-cfn-route:%' GROUP BY run)
SELECT q.run, q.trigger, q.unit_id, kn.kind AS unit_kind, kn.confidence, q.detail FROM q LEFT JOIN kn ON kn.run = q.run AND kn.unit_id = q.unit_id
UNION ALL SELECT fl.run, fl.flag, NULL, NULL, NULL, array_to_string(l[1:5], ' | ') || CASE WHEN len(l) > 5 THEN ' (+' || (len(l) - 5) || ' more)' ELSE '' END FROM fl LEFT JOIN cf ON cf.run = fl.run WHERE flag LIKE 'S5-cfn%'""")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """U-08: the union of all eleven triggers."""
    u, rel, complete = _run(spark, d)
    flags = checkpointed(coverage.silence_flags(complete, ad.runs(spark, d)))
    return coverage.review_items(u, rel, ad.run_ignored(spark, d), complete, flags, ad.run_deployments(spark, d))


@query("WITH " + ad.RUNS_SQL + ", " + ad.IGNORED_SQL + " SELECT run, reason, count(*) AS n FROM ig WHERE reason IN ('AMBIGUOUS_BOUNDARY', 'INSUFFICIENT_EVIDENCE') GROUP BY ALL")
def review_worthy(spark: SparkSession, d: str) -> DataFrame:
    """F-26: rejected rows that are worth a second look, by run."""
    return review.review_worthy(ad.run_ignored(spark, d)).groupBy("run", "reason").agg(F.count("*").alias("n"))


_STATUS = "CASE WHEN kind = 'unresolved' OR coalesce(second, true) OR against THEN 'requires-review' WHEN contract THEN 'externally-verified' WHEN confidence >= 70 THEN 'observed' ELSE 'inferred' END"


@query("WITH " + ad.RUNS_SQL + f", f AS (SELECT *, CASE WHEN confidence % 13 = 0 THEN NULL ELSE confidence % 7 = 0 END AS second, confidence % 11 = 0 AS against, confidence % 5 = 0 AS contract FROM un) SELECT run, unit_id, {_STATUS} AS status FROM f")
def unit_status(spark: SparkSession, d: str) -> DataFrame:
    """F-15: the status of each unit; one without evidence has secondary evidence only."""
    c = F.col("confidence")
    second = F.when(c % 13 != 0, c % 7 == 0)
    return ad.run_units(spark, d).select("run", "unit_id", relations.unit_status(F.col("kind"), second, c % 11 == 0, c % 5 == 0, c).alias("status"))


# ---------------------------------------------------------------- sources: lines

_LINES = "(SELECT DISTINCT root, file, line, text FROM source_lines)"
_DECO = f"""SELECT DISTINCT root, file, line, 'decorator' AS match_source, regexp_extract(text, '^\\s*@([A-Za-z_][\\w.]*)', 1) AS reference_name, nullif(regexp_extract(text, '@[\\w.]+\\s*\\([^"''`]*["''`]([^"''`]*)["''`]', 1), '') AS argument FROM {_LINES} WHERE regexp_extract(text, '^\\s*@([A-Za-z_][\\w.]*)', 1) <> ''"""


@query("SELECT DISTINCT root, file, ext FROM source_files WHERE ext IN ('py', 'ts', 'java')")
def indexed_files(spark: SparkSession, d: str) -> DataFrame:
    """S-01: files of source code."""
    return trees.indexed_files(table(spark, d, "source_files"))


@query(_DECO)
def decorator_facts(spark: SparkSession, d: str) -> DataFrame:
    """S-03: decorators in all lines."""
    return trees.decorator_facts(table(spark, d, "source_lines")).distinct()


@query(f"""WITH h AS (SELECT root, file, line, text, unnest(list_distinct(regexp_extract_all(text, '([A-Za-z_]\\w*(?:\\.[A-Za-z_]\\w*)*)\\s*\\(', 1))) AS f FROM {_LINES} WHERE NOT regexp_matches(text, '^\\s*(?:def|async|public|private|protected|function|class|if|for|while|switch|catch)\\b')),
c AS (SELECT DISTINCT root, file, line, 'call' AS match_source, regexp_extract(f, '([^.]+)$', 1) AS reference_name, nullif(regexp_extract(substr(text, strpos(text, f) + length(f)), '^\\s*\\((.*)\\)', 1), '') AS argument FROM h), dd AS ({_DECO})
SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM dd WHERE dd.root = c.root AND dd.file = c.file AND dd.line = c.line AND regexp_extract(dd.reference_name, '([^.]+)$', 1) = c.reference_name)""")
def call_facts(spark: SparkSession, d: str) -> DataFrame:
    """S-04: calls in all lines, less decorators."""
    return trees.call_facts(table(spark, d, "source_lines").select("root", "file", "line", "text").distinct()).distinct()


@query(f"""SELECT DISTINCT root, file, line, 'field-type' AS match_source, r AS reference_name FROM (SELECT *, CASE WHEN a <> '' THEN a ELSE b END AS r FROM (SELECT *, regexp_extract(text, '\\b(?:private|protected|public|readonly)\\b(?:\\s+(?:static|final|readonly))*\\s+([A-Z]\\w*)\\b(?:<[^>]*>)?\\s+\\w+\\s*[;=]', 1) AS a,
regexp_extract(text, '\\b(?:private|protected|public|readonly)\\b[^:({{]*:\\s*([A-Z]\\w*)', 1) AS b FROM {_LINES})) WHERE r <> ''""")
def type_references(spark: SparkSession, d: str) -> DataFrame:
    """S-05: types of fields in all lines."""
    return trees.type_references(table(spark, d, "source_lines")).distinct()


#: Java files, one for each part, so that headers, packages, annotations and fields are all there.
_JAVA = """jl AS (SELECT 'r' || (p_partkey % 7) AS root, 'src/P' || p_partkey || '.java' AS file, CAST(line AS INTEGER) AS line, text FROM (
  SELECT p_partkey, 1 AS line, 'package example.b' || (p_partkey % 5) || ';' AS text FROM part UNION ALL SELECT p_partkey, 2, CASE p_partkey % 3 WHEN 0 THEN 'import org.postgresql.Driver;' WHEN 1 THEN 'import software.amazon.awssdk.services.dynamodb.DynamoDbClient;' ELSE 'import java.util.List;' END FROM part
  UNION ALL SELECT p_partkey, 3, CASE p_partkey % 4 WHEN 0 THEN '@Configuration' WHEN 1 THEN '' WHEN 2 THEN '// @Configuration' ELSE 'int x = 1;' END FROM part UNION ALL SELECT p_partkey, 4, CASE WHEN p_partkey % 8 = 3 THEN '@Configuration("x")' ELSE '@Service' END FROM part
  UNION ALL SELECT p_partkey, 5, 'public class P' || p_partkey || ' extends Base' || (p_partkey % 9) || '<P' || (p_partkey + 1) || ', Long>' FROM part UNION ALL SELECT p_partkey, 6, '    implements A' || (p_partkey % 3) || ', B {' FROM part
  UNION ALL SELECT p_partkey, 7, '  private final ' || CASE WHEN p_partkey % 6 = 1 THEN 'DynamoDbClient' ELSE 'Store' END || ' store;' FROM part UNION ALL SELECT p_partkey, 8, '}' FROM part))"""


def _java(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    cat = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    texts = [
        cat("package example.b", k % 5, ";"), F.when(k % 3 == 0, "import org.postgresql.Driver;").when(k % 3 == 1, "import software.amazon.awssdk.services.dynamodb.DynamoDbClient;").otherwise("import java.util.List;"),
        F.when(k % 4 == 0, "@Configuration").when(k % 4 == 1, "").when(k % 4 == 2, "// @Configuration").otherwise("int x = 1;"), F.when(k % 8 == 3, '@Configuration("x")').otherwise("@Service"),
        cat("public class P", k, " extends Base", k % 9, "<P", k + 1, ", Long>"), cat("    implements A", k % 3, ", B {"), cat("  private final ", F.when(k % 6 == 1, "DynamoDbClient").otherwise("Store"), " store;"), F.lit("}"),
    ]
    rows = F.explode(F.array(*(F.struct(F.lit(i + 1).alias("line"), t.alias("text")) for i, t in enumerate(texts)))).alias("l")
    return table(spark, d, "part").select(cat("r", k % 7).alias("root"), cat("src/P", k, ".java").alias("file"), rows).select("root", "file", "l.line", "l.text")


@query("WITH " + _JAVA + """ SELECT root, file, line, 'extends' AS match_source, unnest(list_filter(string_split_regex(regexp_replace(regexp_extract(text, '\\b(?:class|interface)\\s+\\w+(?:<[^{]*?>)?\\s+((?:extends|implements)\\b[^{]*)', 1), '<[^{]*>', '', 'g'), '\\s*,\\s*|\\s+'), lambda x: regexp_matches(x, '^[A-Z]'))) AS reference_name FROM jl""")
def extends_facts(spark: SparkSession, d: str) -> DataFrame:
    """S-06: what the classes of all files extend."""
    return trees.extends_facts(_java(spark, d))


@query("WITH " + _JAVA + """ SELECT root, file, arg_min(regexp_extract(text, '^\\s*package\\s+([\\w.]+)\\s*;', 1), line) AS package FROM jl WHERE regexp_matches(text, '^\\s*package\\s+([\\w.]+)\\s*;') GROUP BY ALL""")
def java_packages(spark: SparkSession, d: str) -> DataFrame:
    """S-22: the package of each file."""
    return trees.package_of(_java(spark, d))


@query("WITH " + _JAVA + """, c AS (SELECT root, file, line, regexp_extract(text, '\\b(?:class|interface)\\s+(\\w+)', 1) AS name FROM jl WHERE regexp_matches(text, '\\b(?:class|interface)\\s+\\w+'))
SELECT c.root, c.file, c.line, c.name, regexp_extract(string_agg(jl.text, ' ' ORDER BY jl.line), '^([^{]*)', 1) AS header FROM c JOIN jl ON jl.root = c.root AND jl.file = c.file AND jl.line BETWEEN c.line AND c.line + 9 GROUP BY ALL""")
def class_headers(spark: SparkSession, d: str) -> DataFrame:
    """S-23: headers of classes up to their brace."""
    return trees.class_headers(_java(spark, d))


@query("WITH " + _JAVA + """ SELECT DISTINCT root, file FROM jl WHERE regexp_matches(text, '(?:private|protected|readonly|final|this\\.\\w+\\s*=\\s*new)\\b[^;(]*\\bDynamoDbClient\\b')""")
def class_fields(spark: SparkSession, d: str) -> DataFrame:
    """S-23: files with a field of a type."""
    return trees.has_field_of(_java(spark, d), "DynamoDbClient")


_WIRED = "SELECT root, file, 5 AS line, 'P' || k AS name FROM (SELECT DISTINCT root, file, CAST(regexp_extract(file, '([0-9]+)', 1) AS BIGINT) AS k FROM jl) WHERE k % 8 = 3 OR k % 4 = 0"


@query("WITH " + _JAVA + " " + _WIRED)
def wired_classes(spark: SparkSession, d: str) -> DataFrame:
    """S-23: classes under an annotation, over blank lines, comments and other annotations, but not over code."""
    return trees.annotated_classes(_java(spark, d), "Configuration")


@query("WITH " + _JAVA + " SELECT root, file, 'P' || k AS source, 'P' || (k + 1) AS target, 'references' AS relation FROM (SELECT DISTINCT root, file, CAST(regexp_extract(file, '([0-9]+)', 1) AS BIGINT) AS k FROM jl) WHERE k + 1 IN (SELECT p_partkey FROM part)")
def generic_arguments(spark: SparkSession, d: str) -> DataFrame:
    """S-24: classes that refer to others in the generic arguments of their header."""
    lines = _java(spark, d)
    return trees.generic_argument_edges(lines, trees.class_headers(lines).select(F.col("name").alias("label")))


def _imports(spark: SparkSession, d: str) -> DataFrame:
    return trees.library_imports(evidence.java_imports(_java(spark, d)).select("root", "file", F.col("qualified").alias("target"), F.lit("java").alias("language")), catalog.STORE_LIBRARIES, F.col("language"))


_IMPORTS = "im AS (SELECT root, file, CASE k % 3 WHEN 0 THEN 'org.postgresql.Driver' ELSE 'software.amazon.awssdk.services.dynamodb.DynamoDbClient' END AS target, CASE k % 3 WHEN 0 THEN 'org.postgresql' ELSE 'software.amazon.awssdk.services.dynamodb' END AS library, k FROM (SELECT DISTINCT root, file, CAST(regexp_extract(file, '([0-9]+)', 1) AS BIGINT) AS k FROM jl) WHERE k % 3 < 2)"


@query("WITH " + _JAVA + ", " + _IMPORTS + " SELECT root, file, target, 'java' AS language, library FROM im")
def library_imports(spark: SparkSession, d: str) -> DataFrame:
    """F-19: imports of store libraries."""
    return _imports(spark, d)


@query("WITH " + _JAVA + ", " + _IMPORTS + " SELECT root, file, 'P' || k AS name, library, 5 AS start_line, 8 AS end_line, 'database' AS kind, 20 AS confidence FROM im WHERE k % 10 <> 1 AND NOT (k % 8 = 3 OR k % 4 = 0) AND (k % 3 = 0 OR k % 6 = 1)")
def import_units(spark: SparkSession, d: str) -> DataFrame:
    """J-10: units of classes that import a store library: wiring classes make none, and a client that must be owned needs its field."""
    lines = _java(spark, d)
    headers = trees.class_headers(lines)
    classes = headers.select("root", "file", "name", "line", F.lit(8).alias("last_line"))
    taken = headers.where(F.regexp_extract("name", r"(\d+)", 1).cast("bigint") % 10 == 1)
    owners = None
    for library, kind in catalog.OWNER_FIELDS.items():
        part = headers.join(trees.has_field_of(lines, kind).hint("merge"), ["root", "file"], "left_semi").select("root", "file", "name", F.lit(library).alias("library"))
        owners = part if owners is None else owners.unionByName(part)
    return review.import_units(_imports(spark, d), classes, taken, "database", trees.annotated_classes(lines, catalog.WIRING[0]), owners, list(catalog.OWNER_FIELDS))


@query("WITH " + _JAVA + ", " + _IMPORTS + """, e AS (SELECT root, file, CASE WHEN k % 10 = 0 THEN 'TEST_CODE' ELSE 'CROSS_DOMAIN_UNRESOLVED' END AS reason FROM im WHERE k % 3 = 0)
SELECT root, file, 'unresolved-http-target:' || file AS ref, reason FROM e""")
def outbound_http(spark: SparkSession, d: str) -> DataFrame:
    """F-20: files that import a client; here the driver plays the client, and every tenth file is a test."""
    k = F.regexp_extract("file", r"(\d+)", 1).cast("bigint")
    return review.outbound_http(_imports(spark, d), F.col("library") == "org.postgresql", k % 10 == 0)


@query("""WITH p AS (SELECT p_partkey AS k FROM part), e AS (SELECT 'src/P' || k || '.java' AS file, k, 'src/P' || (k + 1) || '.java' AS target_file FROM p WHERE k + 1 IN (SELECT k FROM p))
SELECT 'r' AS root, file, 'Helper' AS bare, target_file FROM e WHERE CASE WHEN k % 3 = 0 THEN 'example.b' || (k % 4) || '.Helper' <> 'example.b' || ((k + 1) % 5) || '.Helper' ELSE k % 2 = 0 AND 'example.b' || (k % 5) <> 'example.b' || ((k + 1) % 5) END""")
def bare_name_collisions(spark: SparkSession, d: str) -> DataFrame:
    """J-09: references that only share a name, by import or by package."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").select("p_partkey", F.lit("r").alias("root"), F.concat(F.lit("src/P"), k, F.lit(".java")).alias("file"), F.lit("Helper").alias("bare"), F.concat(F.lit("src/P"), k + 1, F.lit(".java")).alias("target_file"))
    package = lambda n: F.concat(F.lit("example.b"), n)
    imports = p.where(k % 3 == 0).select("root", "file", "bare", F.concat(package(k % 4), F.lit(".Helper")).alias("qualified"))
    return trees.bare_name_collisions(p.select("root", "file", "bare", "target_file"), imports, p.select("root", "file", package(k % 5).alias("package")), p.where(k % 2 == 0))


_FOLDERS = "(SELECT DISTINCT root, string_split(file, '/')[:-2] AS f FROM source_files)"


@query(f"""WITH e AS (SELECT root, min(f) AS a, max(f) AS b FROM {_FOLDERS} GROUP BY root) SELECT root, array_to_string(a[1:coalesce(list_max(list_filter(range(1, least(len(a), len(b)) + 1), lambda n: a[1:n] = b[1:n])), 0)], '/') AS folder FROM e""")
def common_folders(spark: SparkSession, d: str) -> DataFrame:
    """S-09: the folder that all files of a root share."""
    return trees.common_folders(table(spark, d, "source_files"))


_ROOTS = "rt AS (SELECT DISTINCT root || '/' || regexp_extract(file, '^([^/]*/[^/]*)/', 1) AS path FROM source_files WHERE file_ord % 3 = 0 AND regexp_matches(file, '^[^/]*/[^/]*/'))"


@query(f"""WITH {_ROOTS}, fo AS (SELECT DISTINCT root || '/' || regexp_extract(file, '^(.*)/', 1) AS folder FROM source_files) SELECT folder FROM fo WHERE NOT EXISTS (SELECT 1 FROM rt WHERE starts_with(rt.path || '/', fo.folder || '/') OR starts_with(fo.folder || '/', rt.path || '/'))""")
def excluded_folders(spark: SparkSession, d: str) -> DataFrame:
    """S-10: folders that no root needs."""
    f = table(spark, d, "source_files")
    roots = f.where("file_ord % 3 = 0").where(F.col("file").rlike("^[^/]*/[^/]*/")).select(F.concat_ws("/", "root", F.regexp_extract("file", "^([^/]*/[^/]*)/", 1)).alias("path")).distinct()
    return trees.excluded_folders(f.select(F.concat_ws("/", "root", F.regexp_extract("file", "^(.*)/", 1)).alias("folder")).distinct(), roots)


@query("""WITH p AS (SELECT DISTINCT root || '/' || file AS path, root FROM source_files), r AS (SELECT DISTINCT root AS rp, 2 AS o FROM source_files UNION ALL SELECT DISTINCT root || '/src', 1 FROM source_files)
SELECT path, arg_min(rp, o) AS root, substr(path, length(arg_min(rp, o)) + 2) AS file FROM p JOIN r ON rp IN (p.root, p.root || '/src') AND starts_with(p.path, rp || '/') GROUP BY path""")
def placed_files(spark: SparkSession, d: str) -> DataFrame:
    """S-11: each path under the first root that holds it."""
    f = table(spark, d, "source_files")
    roots = f.select(F.col("root").alias("path"), F.lit(2).alias("root_ord")).unionByName(f.select(F.concat(F.col("root"), F.lit("/src")).alias("path"), F.lit(1).alias("root_ord"))).distinct()
    return trees.place_files(f.select(F.concat_ws("/", "root", "file").alias("path")).distinct(), roots)


@query("SELECT DISTINCT root, CASE WHEN ext = 'yaml' THEN 'docker-compose.yaml' ELSE 'Dockerfile' END AS file FROM source_files WHERE ext IN ('yaml', 'sh')")
def deployable_roots(spark: SparkSession, d: str) -> DataFrame:
    """S-12: roots with a manifest at their top; YAML and scripts play the manifests."""
    f = table(spark, d, "source_files")
    name = F.when(F.col("ext") == "yaml", "docker-compose.yaml").when(F.col("ext") == "sh", "Dockerfile").otherwise(F.col("file"))
    return trees.deployable_roots(f.select("root", name.alias("file")))


@query(f"SELECT root, file, count(*) AS n_routes FROM ({_NATIVE}) GROUP BY ALL")
def route_summary(spark: SparkSession, d: str) -> DataFrame:
    """A-19: native routes by file."""
    return trees.route_summary(trees.native_routes(table(spark, d, "source_lines")))


@query("""SELECT CASE WHEN o_orderkey % 5 IN (0, 3) THEN 'kept' ELSE 'rejected' END AS outcome, CASE o_orderkey % 5 WHEN 0 THEN 'x, ' || o_orderkey WHEN 3 THEN 'k' || o_orderkey WHEN 1 THEN 'a' || o_orderkey || ',b' WHEN 2 THEN 'a' || o_orderkey || ',b,c,d' ELSE ',b' || o_orderkey || ',c' END AS first FROM orders""")
def binding_rows(spark: SparkSession, d: str) -> DataFrame:
    """S-20: rows of bindings with their number of cells checked, quoted commas and all; what does not fit comes out too."""
    k = F.col("o_orderkey").cast("string")
    n = F.col("o_orderkey") % 5
    line = F.when(n == 0, F.concat(F.lit('"x, '), k, F.lit('",2,3'))).when(n == 3, F.concat(F.lit("k"), k, F.lit(",v,w"))).when(n == 1, F.concat(F.lit("a"), k, F.lit(",b"))).when(n == 2, F.concat(F.lit("a"), k, F.lit(",b,c,d"))).otherwise(F.concat(F.lit(",b"), k, F.lit(",c")))
    rows, bad = trees.bindings_of(table(spark, d, "orders").select(line.alias("value")), ["entity", "table", "file"])
    return rows.select(F.lit("kept").alias("outcome"), F.col("entity").alias("first")).unionByName(bad.select(F.lit("rejected").alias("outcome"), F.col("line").alias("first")))


@query("""SELECT coalesce(language, 'none') AS engine, match_source AS mechanism, count(*) AS n FROM raw_facts WHERE NOT (language IS NOT NULL AND language = 'java' AND match_source = 'decorator') GROUP BY ALL""")
def capability_warnings(spark: SparkSession, d: str) -> DataFrame:
    """S-27: what fired though it is not proven."""
    fired = table(spark, d, "raw_facts").select(F.coalesce("language", F.lit("none")).alias("engine"), F.col("match_source").alias("mechanism"))
    matrix = spark.createDataFrame([("java", "decorator", "proven"), ("java", "call", "partial")], "engine string, mechanism string, state string")
    return review.capability_warnings(fired, matrix)


_GRAPH = f"""f AS (SELECT DISTINCT * FROM raw_facts WHERE from_node_id IS NOT NULL AND from_node_name IS NOT NULL), im AS (SELECT DISTINCT root, file, line, regexp_extract(text, '^\\s*import\\s+(?:static\\s+)?([A-Za-z_][\\w.]*)\\s*;', 1) AS q FROM {_LINES} WHERE regexp_extract(text, '^\\s*import\\s+(?:static\\s+)?([A-Za-z_][\\w.]*)\\s*;', 1) <> ''),
cl AS (SELECT from_node_id AS id, min(line) AS line FROM f GROUP BY ALL), me AS (SELECT from_node_id || '.' || from_node_name AS id, root, file, min(line) AS line FROM f WHERE from_node_kind = 'method' GROUP BY ALL), il AS (SELECT root, file, q, min(line) AS line FROM im GROUP BY ALL)"""


@query(f"""WITH {_GRAPH} SELECT DISTINCT 'file:' || root || ':' || file AS source, from_node_id AS target, 'contains' AS relation, root, file, 1 AS line FROM f
UNION ALL SELECT DISTINCT f.from_node_id, from_node_id || '.' || from_node_name, 'method', f.root, f.file, cl.line FROM f JOIN cl ON cl.id = f.from_node_id WHERE from_node_kind = 'method'
UNION ALL SELECT 'file:' || root || ':' || file, q, 'imports', root, file, line FROM il
UNION ALL SELECT DISTINCT CASE WHEN from_node_kind = 'method' THEN from_node_id || '.' || from_node_name ELSE from_node_id END, reference_name, CASE match_source WHEN 'call' THEN 'calls' WHEN 'extends' THEN 'extends' ELSE 'references' END, root, file, line FROM f""")
def code_graph(spark: SparkSession, d: str) -> DataFrame:
    """S-07, S-08: one graph over all roots, its edges in the form in which they are used."""
    nodes, edges = relations.code_graph(_facts(spark, d), evidence.java_imports(table(spark, d, "source_lines")))
    return relations.normalize_edges(edges, nodes)


# ---------------------------------------------------------------- sources: manifests


def _openapi(spark: SparkSession, d: str) -> DataFrame:
    """An interface document for each root: its routes, and schemes by its name."""
    r = table(spark, d, "raw_facts").where("match_source = 'decorator' and argument is not null").select("root", "argument", F.lower(F.regexp_replace("reference_name", "Mapping$", "")).alias("verb")).distinct()
    verbs = r.groupBy("root", "argument").agg(F.map_from_arrays(F.collect_list("verb"), F.collect_list(F.lit("x"))).alias("verbs")).groupBy("root").agg(F.map_from_entries(F.collect_list(F.struct("argument", "verbs"))).alias("paths"))
    scheme = F.map_from_arrays(F.array(F.concat(F.lit("s-"), "root")), F.array(F.struct(F.lit("http").alias("type"), F.lit("bearer").alias("scheme"))))
    new = F.length("root") % 2 == 0
    doc = F.struct(F.struct(F.col("root").alias("title")).alias("info"), F.col("paths"), F.when(new, F.struct(scheme.alias("securitySchemes"))).alias("components"), F.when(~new, scheme).alias("securityDefinitions"))
    return ad.json_files(verbs.select("root", F.lit("api/openapi.json").alias("file"), doc.alias("doc")))


@query("""SELECT DISTINCT root, 'api/openapi.json' AS file, root AS title, argument AS path, upper(regexp_replace(reference_name, 'Mapping$', '')) AS method FROM raw_facts WHERE match_source = 'decorator' AND argument IS NOT NULL AND lower(regexp_replace(reference_name, 'Mapping$', '')) IN ('get', 'post', 'put', 'patch', 'delete', 'head', 'options', 'trace')""")
def openapi_operations(spark: SparkSession, d: str) -> DataFrame:
    """S-13: operations of interface documents."""
    return manifests.openapi_operations(_openapi(spark, d))


@query("SELECT DISTINCT root, 'api/openapi.json' AS file, 's-' || root AS name, 'http' AS type, 'bearer' AS scheme FROM raw_facts WHERE match_source = 'decorator' AND argument IS NOT NULL")
def openapi_schemes(spark: SparkSession, d: str) -> DataFrame:
    """S-13: security schemes, of either version."""
    return manifests.openapi_schemes(_openapi(spark, d))


@query(f"WITH {ad.DEPLOY_SQL} SELECT name, namespace, image, container_name, config_map AS config_maps, secret || ':' || coalesce(item, '') AS secrets FROM dp")
def k8s_deployments(spark: SparkSession, d: str) -> DataFrame:
    """S-14: deployments of manifests."""
    secrets = F.array_join(F.transform("secret_mounts", lambda m: F.concat_ws(":", m["secret_name"], F.array_join(m["item_keys"], ","))), ";")
    return manifests.k8s_deployments(ad.deployment_files(spark, d)).select("name", "namespace", "image", "container_name", F.array_join("config_map_names", ",").alias("config_maps"), secrets.alias("secrets"))


@query(f"WITH {ad.CONFIG_SQL} SELECT config_map, key, host FROM ck")
def k8s_config_keys(spark: SparkSession, d: str) -> DataFrame:
    """S-15: keys of configuration maps, with the host of each value and nothing else of it."""
    return manifests.k8s_config_keys(ad.deployment_files(spark, d)).select("config_map", "key", "host")


def _units_of_suppliers(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    file = F.concat(F.lit("src/"), F.when(k % 3 == 0, "my-").otherwise(""), F.lit("svc-"), k, F.when(k % 3 == 0, "-impl").otherwise(""), F.lit(".py"))
    return table(spark, d, "supplier").select(F.concat(F.lit("u"), k).alias("unit_id"), file.alias("file"), F.when(k % 8 == 0, "database").otherwise("service").alias("kind"), k.alias("unit_ord"))


_MATCHED_DEPLOY = """su AS (SELECT 'u' || s_suppkey AS unit_id, s_suppkey AS o, CASE WHEN s_suppkey % 3 = 0 THEN 'mysvc' || s_suppkey || 'impl' ELSE 'svc' || s_suppkey END AS b FROM supplier WHERE s_suppkey % 8 <> 0),
nm AS (SELECT 'svc-' || s_suppkey AS name, 'svc' || s_suppkey AS n FROM supplier), bm AS (SELECT unit_id, o, b, arg_min(name, (b <> n, name)) AS name, min(b <> n) AS far FROM su JOIN nm ON contains(b, n) OR contains(n, b) GROUP BY ALL),
md AS (SELECT name, arg_min(unit_id, (far, o)) AS unit_id FROM bm GROUP BY name)"""


@query(f"WITH {_MATCHED_DEPLOY} SELECT name, unit_id FROM md")
def deployment_units(spark: SparkSession, d: str) -> DataFrame:
    """J-15: the unit of each deployment, by equal or contained name."""
    return deploy.deployment_units(manifests.k8s_deployments(ad.deployment_files(spark, d)), _units_of_suppliers(spark, d))


@query(f"WITH {ad.DEPLOY_SQL}, {_MATCHED_DEPLOY} SELECT DISTINCT unit_id, 'k8s-namespace:' || namespace AS node FROM dp JOIN md ON md.name = dp.name")
def placement_edges(spark: SparkSession, d: str) -> DataFrame:
    """J-17: units and their namespaces."""
    return deploy.placement_edges(manifests.k8s_deployments(ad.deployment_files(spark, d)), deployment_units(spark, d))


@query(f"""WITH {ad.DEPLOY_SQL}, g AS (SELECT secret, name, bool_or(coalesce(NOT regexp_matches(item, '(?i)pub'), false)) AS i FROM dp GROUP BY ALL), o AS (SELECT secret, min(name) FILTER (i) AS issuer FROM g GROUP BY secret HAVING count(*) >= 2 AND count(*) FILTER (i) = 1)
SELECT DISTINCT g.name AS from_name, o.issuer AS to_name FROM g JOIN o ON o.secret = g.secret WHERE NOT g.i""")
def secret_trust(spark: SparkSession, d: str) -> DataFrame:
    """J-16: who verifies what who issues, from manifests."""
    return deploy.trust_edges(manifests.k8s_deployments(ad.deployment_files(spark, d)))


@query(f"""WITH {ad.DEPLOY_SQL}, {ad.CONFIG_SQL}, {_MATCHED_DEPLOY}, ref AS (SELECT dp.name, ck.key, ck.host, regexp_extract(ck.key, '^(.*?)(?:_API_ADDR|_ADDR|_URL)$', 1) AS sv FROM dp JOIN ck ON ck.config_map = dp.config_map WHERE ck.key NOT LIKE '%_PORT'),
nr AS (SELECT ref.name, ref.key, ref.host, arg_min(nm.name, (lower(sv) <> n, nm.name)) AS m FROM ref LEFT JOIN nm ON contains(lower(sv), n) OR contains(n, lower(sv)) GROUP BY ALL),
x AS (SELECT name, key, CASE WHEN m <> name THEN m END AS m, CASE WHEN host IN (SELECT name FROM dp) THEN host END AS h FROM nr),
en AS (SELECT name, CASE WHEN contains(image, 'postgres') THEN 'postgresql' WHEN image = 'redis' THEN 'redis' WHEN contains(image, 'mongo') THEN 'mongodb' END AS engine FROM dp)
SELECT DISTINCT x.name AS from_name, key, coalesce(m, CASE WHEN h <> x.name THEN h END) AS to_name, CASE WHEN m IS NOT NULL AND a.name IS NOT NULL AND b.name IS NOT NULL THEN 'edge' WHEN m IS NOT NULL AND a.name IS NOT NULL AND en.engine IS NOT NULL THEN 'database' WHEN m IS NULL AND h IS NOT NULL AND h <> x.name THEN 'candidate' ELSE 'unresolved' END AS outcome
FROM x LEFT JOIN md a ON a.name = x.name LEFT JOIN md b ON b.name = m LEFT JOIN en ON en.name = m""")
def env_edges(spark: SparkSession, d: str) -> DataFrame:
    """J-18: configuration keys that name another deployment."""
    files = ad.deployment_files(spark, d)
    deployments = manifests.k8s_deployments(files)
    return deploy.env_edges(deployments, manifests.k8s_config_keys(files), deploy.deployment_units(deployments, _units_of_suppliers(spark, d)))


def _templates(spark: SparkSession, d: str) -> DataFrame:
    """A template for each nation: its region and itself as resources, its suppliers as methods with their functions."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    low = lambda c: F.regexp_replace(F.lower(c), " ", "-")
    shape = "struct<Type:string,Properties:struct<PathPart:string,ParentId:string,HttpMethod:string,ResourceId:string,Integration:struct<Uri:string>,Handler:string>>"
    res = lambda kind, **p: F.struct(F.lit(kind).alias("Type"), F.struct(*(p.get(k, F.lit(None).cast("string")).alias(k) for k in ("PathPart", "ParentId", "HttpMethod", "ResourceId")), F.struct(p.get("Uri", F.lit(None).cast("string")).alias("Uri")).alias("Integration"), p.get("Handler", F.lit(None).cast("string")).alias("Handler")).alias("Properties")).cast(shape)
    entry = lambda k, v: F.struct(k.alias("k"), v.alias("v"))
    region, nation = F.concat(F.lit("R"), "r_regionkey"), F.concat(F.lit("N"), "n_nationkey")
    own = n.select("n_nationkey", F.explode(F.array(entry(region, res("AWS::ApiGateway::Resource", PathPart=low("r_name"), ParentId=F.lit("Api.RootResourceId"))), entry(nation, res("AWS::ApiGateway::Resource", PathPart=low("n_name"), ParentId=region)))).alias("e"))
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    verb = F.element_at(F.array(*(F.lit(x) for x in ("GET", "POST", "OPTIONS"))), (k % 3 + 1).cast("int"))
    method = res("AWS::ApiGateway::Method", HttpMethod=verb, ResourceId=F.concat(F.lit("N"), "s_nationkey"), Uri=F.concat(F.lit("arn:x/${F"), k, F.lit(".Arn}/invocations")))
    function = res("AWS::Lambda::Function", Handler=F.concat(F.lit("pkg.H"), k, F.lit("::handle")))
    more = s.select(F.col("s_nationkey").alias("n_nationkey"), F.explode(F.array(entry(F.concat(F.lit("M"), k), method), entry(F.concat(F.lit("F"), k), function))).alias("e"))
    docs = own.unionByName(more).groupBy("n_nationkey").agg(F.map_from_entries(F.collect_list("e")).alias("Resources"))
    return ad.json_files(docs.select(F.lit("cfn").alias("root"), F.concat(F.lit("t/"), "n_nationkey", F.lit(".json")).alias("file"), F.struct("Resources").alias("doc")))


_CFN = "cr AS (SELECT '/' || replace(lower(r_name), ' ', '-') || '/' || replace(lower(n_name), ' ', '-') AS path, ['GET', 'POST', 'OPTIONS'][s_suppkey % 3 + 1] AS method, s_suppkey AS k FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey)"


@query(f"WITH {_CFN} SELECT path, method, 'pkg.H' || k || '::handle' AS handler FROM cr WHERE method <> 'OPTIONS'")
def cfn_routes(spark: SparkSession, d: str) -> DataFrame:
    """S-16: methods of templates with their paths and handlers."""
    return manifests.cfn_routes(_templates(spark, d))


@query(f"""WITH {_CFN}, hu AS (SELECT s_suppkey AS k, 'u' || s_suppkey AS unit_id FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'v' || s_suppkey FROM supplier WHERE s_suppkey % 10 = 0), g AS (SELECT path, method, count(DISTINCT unit_id) AS n, min(unit_id) AS u FROM cr LEFT JOIN hu ON hu.k = cr.k WHERE method <> 'OPTIONS' GROUP BY ALL)
SELECT path, method, CASE WHEN n = 1 THEN u END AS unit_id, CASE n WHEN 0 THEN 'zero' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS outcome FROM g""")
def cfn_handlers(spark: SparkSession, d: str) -> DataFrame:
    """J-14: routes at the one unit whose file is the handler's class."""
    k = F.col("s_suppkey")
    unit = lambda df, letter: df.select(F.concat(F.lit(letter), k).alias("unit_id"), F.concat(F.lit(f"src/{letter}/H"), k, F.lit(".java")).alias("file"))
    s = table(spark, d, "supplier")
    return deploy.cfn_handlers(cfn_routes(spark, d), unit(s.where(k % 2 == 0), "u").unionByName(unit(s.where(k % 10 == 0), "v")))


_PROPS = "pl AS (SELECT DISTINCT root, regexp_replace(file, '([^/]+)\\.properties$', 'application-\\1.properties') AS file, regexp_extract(file, '([^/]+)\\.properties$', 1) AS profile, line, replace(replace(coalesce(text, ''), chr(13), ''), chr(10), '') AS t FROM source_lines WHERE file LIKE '%.properties')"


@query(f"""WITH {_PROPS}, kv AS (SELECT *, trim(regexp_extract(t, '^\\s*([^:=]*)[:=]', 1)) AS key, trim(regexp_extract(t, '^[^:=]*[:=](.*)$', 1)) AS value FROM pl WHERE NOT regexp_matches(trim(t), '^[#!]') AND regexp_matches(t, '[:=]'))
SELECT root, file, profile, CAST(NULL AS VARCHAR) AS doc_profile, key, arg_max(value, (line, t)) AS value FROM kv WHERE key <> '' GROUP BY ALL""")
def spring_properties(spark: SparkSession, d: str) -> DataFrame:
    """S-17: settings of all property files, read as profiles of one application; the last of a key wins."""
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), "[\r\n]", "")
    lines = table(spark, d, "source_lines").where(F.col("file").endswith(".properties")).select("root", F.regexp_replace("file", r"([^/]+)\.properties$", "application-$1.properties").alias("file"), "line", bare.alias("t")).distinct()
    texts = lines.groupBy("root", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "t"))), lambda x: x["t"]), "\n").alias("text"))
    return manifests.spring_properties(texts)


@query("""WITH p AS (SELECT DISTINCT p_brand, p_partkey, p_name FROM part) SELECT DISTINCT p_brand AS root, p_name || '-' || (p_partkey % 3) AS name, CAST(p_partkey % 5 AS VARCHAR) AS version, CASE WHEN p_partkey % 2 = 0 THEN 'pkg:x/' || p_partkey END AS purl FROM p""")
def sbom_components(spark: SparkSession, d: str) -> DataFrame:
    """S-18: components of bills of material, a hundred parts to a document."""
    k = F.col("p_partkey")
    part = F.struct(F.concat("p_name", F.lit("-"), k % 3).alias("name"), (k % 5).cast("string").alias("version"), F.when(k % 2 == 0, F.concat(F.lit("pkg:x/"), k)).alias("purl"))
    docs = table(spark, d, "part").groupBy("p_brand", F.floor(k / 100).alias("n")).agg(F.collect_list(part).alias("components"))
    files = ad.json_files(docs.select(F.col("p_brand").alias("root"), F.concat(F.lit("bom"), "n", F.lit(".json")).alias("file"), F.struct(F.lit("CycloneDX").alias("bomFormat"), "components").alias("doc")))
    return manifests.sbom_components(files)


def _contract_files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    n = k % 4
    one = F.struct(F.concat(F.lit("c"), k).alias("nodeId"), F.col("s_name").alias("name"), F.when(n < 2, F.struct(F.concat(F.lit("api-"), k % 50).alias("title"))).alias("apiSpec"), F.when(n.isin(1, 2), F.struct(F.concat(F.lit("art-"), k % 40).alias("coordinates"))).alias("artifact"), F.when(n == 3, F.struct(F.concat(F.lit("cat-"), k % 30).alias("dns"))).alias("serviceCatalogue"))
    return ad.json_files(table(spark, d, "supplier").select(F.lit("repos").alias("root"), F.concat(F.lit("m/"), k, F.lit(".json")).alias("file"), F.struct(F.concat(F.lit("repo-"), k).alias("repo"), F.array(one).alias("publishes")).alias("doc")))


_CONTRACTS = "co AS (SELECT 'repo-' || s_suppkey AS repo, 'c' || s_suppkey AS node_id, s_name AS name, CASE WHEN s_suppkey % 4 < 2 THEN 'api-' || (s_suppkey % 50) END AS api_title, CASE WHEN s_suppkey % 4 IN (1, 2) THEN 'art-' || (s_suppkey % 40) END AS artifact, CASE WHEN s_suppkey % 4 = 3 THEN 'cat-' || (s_suppkey % 30) END AS svc_dns FROM supplier)"


@query(f"WITH {_CONTRACTS} SELECT repo, 0 AS ord, node_id, name, api_title, artifact, CAST(NULL AS VARCHAR) AS svc_name, svc_dns FROM co")
def repo_contracts(spark: SparkSession, d: str) -> DataFrame:
    """S-19: contracts that repositories publish."""
    return manifests.repo_contracts(_contract_files(spark, d))


@query(f"""WITH {_CONTRACTS}, rt AS (SELECT 'r' || c_custkey AS root, 'api-' || (c_custkey % 90) AS a, 'art-' || (c_custkey % 80) AS b, 'cat-' || (c_custkey % 70) AS c FROM customer),
j AS (SELECT root, node_id, 1 AS tier FROM rt JOIN co ON a = api_title UNION ALL SELECT root, node_id, 2 FROM rt JOIN co ON b = artifact UNION ALL SELECT root, node_id, 3 FROM rt JOIN co ON c = svc_dns) SELECT root, node_id, min(tier) AS tier FROM j GROUP BY ALL""")
def cross_repo_edges(spark: SparkSession, d: str) -> DataFrame:
    """J-20: roots and the contracts they use, each pair at its first tier."""
    k = F.col("c_custkey")
    name = lambda p, n: F.concat(F.lit(p), k % n)
    roots = table(spark, d, "customer").select(F.concat(F.lit("r"), k).alias("root"), name("api-", 90).alias("api_title"), name("art-", 80).alias("coordinate"), name("cat-", 70).alias("service"))
    return deploy.cross_repo_edges(roots, repo_contracts(spark, d))


@query("""WITH l AS (SELECT DISTINCT p_brand AS root, 'lib' || (p_partkey % 400) AS name FROM part), n AS (SELECT root, count(*) AS n, min(name) AS library FROM l WHERE name IN ('lib7', 'lib11', 'lib200') GROUP BY root), k AS (SELECT 'Brand#' || (s_suppkey % 30) AS root, count(*) AS n FROM supplier WHERE s_suppkey % 11 = 0 GROUP BY ALL)
SELECT n.root, CASE WHEN n.n = 1 AND coalesce(k.n, 0) = 0 THEN 'introduced' WHEN n.n = 1 AND k.n = 1 THEN 'corroborated' ELSE 'ambiguous' END AS outcome, CASE WHEN n.n = 1 THEN library END AS library FROM n LEFT JOIN k ON k.root = n.root""")
def sbom_corroboration(spark: SparkSession, d: str) -> DataFrame:
    """J-23: store libraries of bills of material against the units of their root."""
    components = table(spark, d, "part").select(F.col("p_brand").alias("root"), F.concat(F.lit("lib"), F.col("p_partkey") % 400).alias("name"))
    stores = spark.createDataFrame([("lib7",), ("lib11",), ("lib200",)], "library string")
    units = table(spark, d, "supplier").select(F.concat(F.lit("Brand#"), F.col("s_suppkey") % 30).alias("root"), F.when(F.col("s_suppkey") % 11 == 0, "database").otherwise("service").alias("kind"))
    return deploy.sbom_corroboration(components, stores, units)


@query("""SELECT 'r' || s_nationkey AS root, file, file || p || '::' || suffix AS unit_id, kind, 40 AS weight, argument, scheme FROM (SELECT s_nationkey, 'app' || s_suppkey || '.yml' AS file, CASE WHEN s_suppkey % 3 = 0 THEN '#prod' ELSE '' END AS p, unnest([
  {'suffix': 'datasource', 'kind': 'database', 'argument': CASE WHEN s_suppkey % 2 = 0 THEN 'jdbc:mysql://db' || s_suppkey WHEN s_suppkey % 5 = 0 THEN '${DB:jdbc:postgresql://h}' END, 'scheme': CASE WHEN s_suppkey % 2 = 0 THEN 'mysql' WHEN s_suppkey % 5 = 0 THEN 'postgresql' END},
  {'suffix': 'kafka', 'kind': 'topic', 'argument': CASE WHEN s_suppkey % 4 = 1 THEN 'k:9092' END, 'scheme': NULL}, {'suffix': 'rabbit', 'kind': 'topic', 'argument': CASE WHEN s_suppkey % 7 = 0 THEN 'mq:5672' WHEN s_suppkey % 7 = 1 THEN 'mq:' || s_suppkey END, 'scheme': NULL},
  {'suffix': 'redis', 'kind': 'database', 'argument': CASE WHEN s_suppkey % 6 = 2 THEN 'r:6379' END, 'scheme': NULL}], recursive := true) FROM supplier) WHERE argument IS NOT NULL""")
def spring_units(spark: SparkSession, d: str) -> DataFrame:
    """F-21: stores and brokers that configuration names."""
    k = F.col("s_suppkey")
    pair = lambda key, value: F.when(value.isNotNull(), F.struct(F.lit(key).alias("key"), value.alias("value")))
    rows = F.array_compact(F.array(
        pair("spring.datasource.url", F.when(k % 2 == 0, F.concat(F.lit("jdbc:mysql://db"), k))), pair("spring.datasource.hikari.jdbc-url", F.when(k % 5 == 0, "${DB:jdbc:postgresql://h}")), pair("spring.kafka.bootstrap-servers", F.when(k % 4 == 1, "k:9092")),
        pair("spring.rabbitmq.host", F.when(k % 7 < 2, "mq")), pair("spring.rabbitmq.port", F.when(k % 7 == 1, k.cast("string"))), pair("spring.redis.host", F.when(k % 6 == 2, "r")), pair("server.port", F.lit("80")),
    ))
    none = F.lit(None).cast("string")
    props = table(spark, d, "supplier").select(F.concat(F.lit("r"), "s_nationkey").alias("root"), F.concat(F.lit("app"), k, F.lit(".yml")).alias("file"), none.alias("profile"), F.when(k % 3 == 0, "prod").alias("doc_profile"), F.explode(rows).alias("r")).select("root", "file", "profile", "doc_profile", "r.key", "r.value")
    return deploy.spring_units(props)
