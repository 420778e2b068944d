"""Queries of the operators on evidence, relationships, documents and review records, each over views of the tables at hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text as fn
from gristmill.operators import catalog, deploy, documents, evidence, relations, review, runs
from gristmill.plans import adapters as ad
from gristmill.plans import sinks
from gristmill.plans.pipeline import _UNITS, query, units
from gristmill.session import table

_RUNS = "WITH " + ad.RUNS_SQL


def _cat(*xs) -> F.Column:
    return F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))


# ---------------------------------------------------------------- evidence

_CALLS = """ev AS (SELECT event_id, CASE event_type WHEN 'error' THEN 'PreAuthorize' WHEN 'click' THEN 'xvalidateHasPermission' WHEN 'view' THEN 'oauth2' WHEN 'signup' THEN 'jwt.decode' ELSE 'Thread.sleep' END AS s, CASE user_id % 3 WHEN 0 THEN 'java' WHEN 1 THEN 'python' END AS l, user_id FROM events)"""


def _calls(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    s = F.when(t == "error", "PreAuthorize").when(t == "click", "xvalidateHasPermission").when(t == "view", "oauth2").when(t == "signup", "jwt.decode").otherwise("Thread.sleep")
    k = F.col("user_id") % 3
    return table(spark, d, "events").select("event_id", s.alias("reference_name"), F.when(k == 0, "java").when(k == 1, "python").alias("language"), "user_id")


@query(f"""WITH {_CALLS} SELECT s AS reference_name, l AS language, CASE s WHEN 'PreAuthorize' THEN 'security-rbac-001' WHEN 'xvalidateHasPermission' THEN 'security-rbac-002' WHEN 'oauth2' THEN 'security-contract-oauth2-001' WHEN 'jwt.decode' THEN 'security-auth-001' END AS control_id, count(*) AS n FROM ev GROUP BY ALL""")
def control_match(spark: SparkSession, d: str) -> DataFrame:
    """F-04: the control of each call, of its language or else the first. The middle one of three signals has no word boundary, so xvalidateHasPermission is one of them."""
    return evidence.match_controls(_calls(spark, d), catalog.controls(spark)).groupBy("reference_name", "language", "control_id").agg(F.count("*").alias("n"))


@query(f"""WITH {_CALLS} SELECT DISTINCT 'r' || (user_id % 5) AS root, 'f' || user_id || ':' || (event_id % 20) AS ref, 'INSUFFICIENT_EVIDENCE' AS reason, 'hand-rolled-resilience-candidate: calls "Thread.sleep" at f' || user_id || ':' || (event_id % 20) AS detail FROM ev WHERE s = 'Thread.sleep'""")
def resilience_candidates(spark: SparkSession, d: str) -> DataFrame:
    """F-11: calls that may be a retry written by hand."""
    f = _calls(spark, d).select(_cat("r", F.col("user_id") % 5).alias("root"), _cat("f", F.col("user_id")).alias("file"), (F.col("event_id") % 20).alias("line"), F.lit("call").alias("match_source"), "reference_name")
    return evidence.resilience_candidates(f)


@query("""SELECT user_id AS unit_id, coalesce(bool_or(event_type = 'click'), false) AS has_retry, coalesce(bool_or(event_type IN ('view', 'signup')), false) AS has_timeout FROM events WHERE event_type <> 'error' AND event_id % 7 < 2 GROUP BY user_id""")
def resilience_units(spark: SparkSession, d: str) -> DataFrame:
    """F-13: units with retries and timeouts by where their evidence comes from."""
    t = F.col("event_type")
    source = F.when(t == "click", "decorator").when(t == "view", "spring-config").when(t == "signup", "structured-config").otherwise("call")
    e = table(spark, d, "events").select(F.col("user_id").alias("unit_id"), F.when((t != "error") & (F.col("event_id") % 7 < 2), "resilience").otherwise("messaging").alias("category"), source.alias("source"))
    return evidence.resilience_of(e, ["unit_id"])


@query(_UNITS + " SELECT root, name, CAST(confidence AS BIGINT) AS confidence FROM u WHERE confidence >= 40 UNION ALL SELECT DISTINCT root, 'import', 20 FROM raw_facts WHERE language = 'python'")
def floor_exemptions(spark: SparkSession, d: str) -> DataFrame:
    """F-06: units above the floor, with those that imports introduce."""
    kept, _ = evidence.floor_split(units(spark, d))
    exempt = table(spark, d, "raw_facts").where("language = 'python'").select("root", F.lit("import").alias("name"), F.lit(20).cast("bigint").alias("confidence")).distinct()
    return evidence.with_exempt(kept.select("root", "name", "confidence"), exempt)


_WEAK = "wu AS (SELECT DISTINCT 'r' || (user_id % 4) AS root, 'f' || (user_id % 90) AS file, 'u' || user_id AS unit_id FROM events), we AS (SELECT 'r' || (user_id % 4) AS root, 'f' || (user_id % 90) AS file, 'u' || user_id AS unit_id, CASE WHEN user_id % 3 = 0 OR event_type = 'view' THEN 'framework-bootstrap' ELSE 'persistence' END AS category, event_id FROM events), ws AS (SELECT DISTINCT root, file, 'topic-' || file AS unit_id FROM wu WHERE CAST(substr(file, 2) AS INT) % 2 = 0)"


def _weak(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    u = F.col("user_id")
    e = table(spark, d, "events").select(_cat("r", u % 4).alias("root"), _cat("f", u % 90).alias("file"), _cat("u", u).alias("unit_id"), F.when((u % 3 == 0) | (F.col("event_type") == "view"), "framework-bootstrap").otherwise("persistence").alias("category"), "event_id")
    own = e.select("root", "file", "unit_id").distinct()
    strong = own.where(F.substring("file", 2, 9).cast("int") % 2 == 0).select("root", "file", _cat("topic-", F.col("file")).alias("unit_id")).distinct()
    return own, e, strong


@query(f"WITH {_WEAK}, wk AS (SELECT root, file, unit_id FROM we GROUP BY ALL HAVING bool_and(category = 'framework-bootstrap')), mv AS (SELECT wk.unit_id AS old, ws.unit_id AS new FROM wk JOIN ws ON ws.root = wk.root AND ws.file = wk.file) SELECT coalesce(mv.new, we.unit_id) AS unit_id, count(*) AS n, (SELECT count(*) FROM wu WHERE unit_id NOT IN (SELECT old FROM mv)) AS kept FROM we LEFT JOIN mv ON mv.old = we.unit_id GROUP BY 1")
def weak_unit_replacement(spark: SparkSession, d: str) -> DataFrame:
    """J-11: evidence by unit after stronger units took that of services known by a stereotype only."""
    kept, moved = deploy.replace_weak(*_weak(spark, d))
    return moved.groupBy("unit_id").agg(F.count("*").alias("n")).join(kept.agg(F.count("*").alias("kept")), F.lit(True))  # one row


@query(f"WITH {_WEAK} SELECT 'kept' AS outcome, count(*) AS n FROM (SELECT event_id FROM we WHERE event_id % 2 = 0 UNION ALL SELECT event_id FROM we WHERE event_id % 2 = 1 AND unit_id IN (SELECT unit_id FROM wu WHERE CAST(substr(unit_id, 2) AS BIGINT) % 4 <> 0)) UNION ALL SELECT 'rest', count(*) FROM we WHERE event_id % 2 = 1 AND CAST(substr(unit_id, 2) AS BIGINT) % 4 = 0")
def appended_evidence(spark: SparkSession, d: str) -> DataFrame:
    """J-12: evidence that goes to units that are there, and what has none."""
    own, e, _ = _weak(spark, d)
    there = own.where(F.substring("unit_id", 2, 9).cast("bigint") % 4 != 0)
    kept, rest = evidence.append_evidence(there, e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1"))
    one = lambda df, name: df.agg(F.lit(name).alias("outcome"), F.count("*").alias("n"))
    return one(kept, "kept").unionByName(one(rest, "rest"))


@query("SELECT user_id % 10 AS grp, count(*) AS n_units, count(DISTINCT sig) AS n_signatures FROM (SELECT user_id, string_agg(event_type || '~' || (event_id % 2), ';' ORDER BY event_type || '~' || (event_id % 2)) AS sig FROM events WHERE value > 90 GROUP BY user_id) GROUP BY 1")
def evidence_signatures(spark: SparkSession, d: str) -> DataFrame:
    """A-14: how many units differ in their evidence."""
    e = table(spark, d, "events").where("value > 90").groupBy("user_id").agg(runs.signature([F.col("event_type"), (F.col("event_id") % 2).cast("string")]).alias("sig"))
    return e.groupBy((F.col("user_id") % 10).alias("grp")).agg(F.count("*").alias("n_units"), F.count_distinct("sig").alias("n_signatures"))


# ---------------------------------------------------------------- relationships


@query(_RUNS + """, b AS (SELECT run, 'src/' || from_id || '.java' AS f, CASE WHEN confidence % 4 = 0 THEN 'src/new' || (confidence % 9) || '.java' ELSE 'src/' || to_id || '.java' END AS t, row_number() OVER () AS z FROM rel),
u AS (SELECT run, file, min(unit_id) AS unit_id FROM un GROUP BY ALL), j AS (SELECT b.run, a.unit_id AS from_id, coalesce(c.unit_id, b.t) AS to_id, c.unit_id IS NULL AS fresh FROM b JOIN u a ON a.run = b.run AND a.file = b.f LEFT JOIN u c ON c.run = b.run AND c.file = b.t)
SELECT DISTINCT 'edge' AS what, from_id, to_id FROM j WHERE from_id <> to_id AND NOT EXISTS (SELECT 1 FROM rel WHERE rel.from_id = j.from_id AND rel.to_id = j.to_id AND grade = 'structural') UNION ALL SELECT DISTINCT 'unit', CAST(run AS VARCHAR), to_id FROM j WHERE fresh""")
def bound_edges(spark: SparkSession, d: str) -> DataFrame:
    """J-21: edges of bindings, and the units that they introduce."""
    rel = ad.run_relationships(spark, d)
    c = F.col("confidence")
    path = lambda x: _cat("src/", F.col(x), ".java")
    b = rel.select(F.col("run").alias("root"), path("from_id").alias("from_file"), F.when(c % 4 == 0, _cat("src/new", c % 9, ".java")).otherwise(path("to_id")).alias("to_file"), F.col("id").alias("ord"))
    u = ad.run_units(spark, d).select(F.col("run").alias("root"), "file", "unit_id")
    edges, new = deploy.bind_edges(b, u, rel.where("grade = 'structural'").select("from_id", "to_id"), F.lit(7))
    return edges.select(F.lit("edge").alias("what"), "from_id", "to_id").unionByName(new.select(F.lit("unit").alias("what"), F.col("root").cast("string").alias("from_id"), F.col("unit_id").alias("to_id")))


@query(_RUNS + """, t AS (SELECT s_nationkey AS run, 'src/s' || s_suppkey || '.java' AS file, count(DISTINCT l_partkey % 40) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_partkey % 40 < s_suppkey % 12 GROUP BY ALL)
SELECT un.run, unit_id, CASE WHEN kind = 'database' THEN least(100, confidence + 10 * coalesce(t.n, 0)) ELSE confidence END AS confidence FROM un LEFT JOIN t ON t.run = un.run AND t.file = un.file""")
def table_enrichment(spark: SparkSession, d: str) -> DataFrame:
    """J-22: databases with the tables that are bound to them."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    t = table(spark, d, "lineitem").select("l_suppkey", (F.col("l_partkey") % 40).alias("t")).where("t < l_suppkey % 12").join(s, "l_suppkey").select(F.col("s_nationkey").alias("root"), _cat("src/s", F.col("l_suppkey"), ".java").alias("file"), F.col("t").cast("string").alias("table"))
    u = ad.run_units(spark, d).withColumnRenamed("run", "root")
    return deploy.enrich_tables(u, t).select(F.col("root").alias("run"), "unit_id", F.col("confidence").cast("bigint").alias("confidence"))


_DI = """fd AS (SELECT 'r' || (p_partkey % 3) AS root, 'P' || p_partkey AS owner, 'f' || p_size AS field, 'I' || (p_partkey % 50) AS interface, p_partkey % 3 <> 0 AS fin, CASE p_partkey % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'map' ELSE 'collection' END AS shape FROM part),
st AS (SELECT 'r' || (s_suppkey % 3) AS root, 'I' || (s_suppkey % 60) AS interface, 'S' || s_suppkey AS impl, CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE 'q' || (s_suppkey % 5) END AS qualifier FROM supplier), bn AS (SELECT root, 'I' || (CAST(substr(impl, 2) AS BIGINT) % 45) AS interface, impl FROM st WHERE CAST(substr(impl, 2) AS BIGINT) % 4 = 0)"""


def _di(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    k, s = F.col("p_partkey"), F.col("s_suppkey")
    shape = F.when(k % 3 == 0, "plain").when(k % 3 == 1, "map").otherwise("collection")
    fields = table(spark, d, "part").select(_cat("r", k % 3).alias("root"), _cat("P", k).alias("owner"), _cat("f", F.col("p_size")).alias("field"), _cat("I", k % 50).alias("interface"), (k % 3 != 0).alias("is_final"), shape.alias("shape"))
    impl = table(spark, d, "supplier").select(_cat("r", s % 3).alias("root"), _cat("I", s % 60).alias("interface"), _cat("S", s).alias("impl"), F.when(s % 2 == 0, "").otherwise(_cat("q", s % 5)).alias("qualifier"), s.alias("k"))
    return fields, impl, impl.where("k % 4 = 0").select("root", _cat("I", F.col("k") % 45).alias("interface"), "impl")


@query(f"""WITH {_DI}, a AS (SELECT root, interface, min(impl) AS impl FROM st GROUP BY ALL HAVING count(DISTINCT impl) = 1), b AS (SELECT root, interface, min(impl) AS impl FROM bn GROUP BY ALL HAVING count(DISTINCT impl) = 1)
SELECT DISTINCT root, owner, field, interface, impl, 'stereotype' AS mechanism FROM fd JOIN a USING (root, interface) WHERE fin UNION ALL SELECT DISTINCT root, owner, field, interface, impl, 'bean-factory' FROM fd JOIN b USING (root, interface) WHERE fin""")
def di_resolution(spark: SparkSession, d: str) -> DataFrame:
    """J-25: what is injected, by stereotype or factory, where there is just one."""
    fields, impl, beans = _di(spark, d)
    return relations.di_resolution(fields, impl, beans)


@query(f"""WITH {_DI}, a AS (SELECT root, interface, min(impl) AS impl, min(qualifier) AS qualifier FROM st GROUP BY ALL HAVING count(DISTINCT impl) = 1)
SELECT DISTINCT root, owner, field, interface, impl, 'single-implementer' AS mechanism, qualifier FROM fd JOIN a USING (root, interface) WHERE shape = 'plain' UNION ALL SELECT DISTINCT root, owner, field, interface, impl, 'map-role-hint', qualifier FROM fd JOIN st USING (root, interface) WHERE shape = 'map' AND qualifier <> ''
UNION ALL SELECT DISTINCT root, owner, field, interface, impl, 'collection-multibind', qualifier FROM fd JOIN st USING (root, interface) WHERE shape = 'collection'""")
def named_bindings(spark: SparkSession, d: str) -> DataFrame:
    """J-26: injected fields and their named implementers."""
    fields, impl, _ = _di(spark, d)
    return relations.named_bindings(fields, impl.select("root", "interface", "impl", "qualifier"))


@query("SELECT 'r' || (p_partkey % 4) AS root, 'E' || p_partkey || '.java' AS file, 'E' || p_partkey AS class, 't' || p_size AS \"table\" FROM part WHERE p_partkey % 3 <> 0 AND p_partkey % 5 <> 0")
def entity_tables(spark: SparkSession, d: str) -> DataFrame:
    """J-26: entities with the tables that they name."""
    k = F.col("p_partkey")
    own = table(spark, d, "part").select(_cat("r", k % 4).alias("root"), _cat("E", k, ".java").alias("file"), _cat("id", k).alias("from_node_id"), F.lit("class").alias("from_node_kind"), _cat("E", k).alias("from_node_name"), "p_partkey", "p_size")
    entity = own.where(k % 3 != 0).select("root", "file", "from_node_id", "from_node_kind", "from_node_name", F.lit("Entity").alias("reference_name"), F.lit(None).cast("string").alias("argument"))
    named = own.select("root", "file", "from_node_id", "from_node_kind", "from_node_name", F.lit("Table").alias("reference_name"), F.when(k % 5 != 0, F.when(k % 2 == 0, _cat('name = "t', F.col("p_size"), '"')).otherwise(_cat("t", F.col("p_size")))).alias("argument"))
    return relations.entity_tables(entity.unionByName(named))


@query(_RUNS + ", nd AS (SELECT unit_id FROM un WHERE confidence % 9 <> 0), j AS (SELECT id, CASE WHEN a.unit_id IS NULL AND b.unit_id IS NULL THEN 'both' WHEN a.unit_id IS NULL THEN 'source' WHEN b.unit_id IS NULL THEN 'target' END AS missing FROM rel LEFT JOIN nd a ON a.unit_id = from_id LEFT JOIN nd b ON b.unit_id = to_id) SELECT id, coalesce(missing, 'kept') AS missing FROM j")
def endpoint_integrity(spark: SparkSession, d: str) -> DataFrame:
    """J-27: relationships whose ends are nodes, and what the others lack."""
    kept, gaps = documents.endpoint_integrity(ad.run_relationships(spark, d), ad.run_units(spark, d).where("confidence % 9 <> 0"))
    return kept.select("id", F.lit("kept").alias("missing")).unionByName(gaps.select("id", "missing"))


@query("""WITH m(a, b, v) AS (VALUES ('O', 'N', 'connects'), ('F', 'R', 'returns'), ('F', 'A', 'accepts')) SELECT l_orderkey, l_linenumber, coalesce(v, 'default') AS shape FROM lineitem LEFT JOIN m ON a = l_linestatus AND b = l_returnflag""")
def mapping_default(spark: SparkSession, d: str) -> DataFrame:
    """J-28: each line's mapping, or else the default one."""
    m = spark.createDataFrame([("O", "N", "connects"), ("F", "R", "returns"), ("F", "A", "accepts"), (None, None, "default")], "l_linestatus string, l_returnflag string, shape string")
    return review.lookup_with_default(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_linestatus", "l_returnflag"), m, ["l_linestatus", "l_returnflag"], "shape").select("l_orderkey", "l_linenumber", "shape")


@query(_RUNS + """, ev AS (SELECT 's' || l_suppkey AS unit_id, l_orderkey * 8 + l_linenumber AS ord, CASE WHEN l_quantity > 30 THEN l_returnflag END AS p FROM lineitem WHERE l_suppkey % 3 = 0 UNION ALL SELECT 'c' || o_custkey, o_orderkey, o_orderstatus FROM orders WHERE o_custkey % 4 = 0), f AS (SELECT unit_id, arg_min(p, ord) AS p FROM ev WHERE p IS NOT NULL GROUP BY unit_id)
SELECT rel.id, coalesce(CASE WHEN rel.confidence % 10 = 0 THEN 'rule' END, t.p, s.p) AS protocol FROM rel LEFT JOIN f t ON t.unit_id = to_id LEFT JOIN f s ON s.unit_id = from_id""")
def protocols(spark: SparkSession, d: str) -> DataFrame:
    """J-29: the protocol of each relationship: its rule's, its target's or its source's."""
    li, o = table(spark, d, "lineitem"), table(spark, d, "orders")
    e = li.where("l_suppkey % 3 = 0").select(_cat("s", F.col("l_suppkey")).alias("unit_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"), F.when(F.col("l_quantity") > 30, F.col("l_returnflag")).alias("protocol"))
    e = e.unionByName(o.where("o_custkey % 4 = 0").select(_cat("c", F.col("o_custkey")).alias("unit_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("protocol")))
    return review.infer_protocol(ad.run_relationships(spark, d), e, F.when(F.col("confidence") % 10 == 0, "rule")).select("id", "protocol")


# ---------------------------------------------------------------- documents

_KIND = "CASE WHEN confidence % 10 = 0 THEN 'queue' ELSE kind END"


def _odd_units(spark: SparkSession, d: str) -> DataFrame:
    return ad.run_units(spark, d).withColumn("kind", F.when(F.col("confidence") % 10 == 0, "queue").otherwise(F.col("kind")))


@query(_RUNS + f" SELECT unit_id, CASE {_KIND} WHEN 'topic' THEN 'network' WHEN 'queue' THEN NULL ELSE kind END AS node_type FROM un")
def node_projection(spark: SparkSession, d: str) -> DataFrame:
    """F-22: units as nodes; kinds without node type are gaps."""
    nodes, gaps = documents.project_nodes(_odd_units(spark, d))
    return nodes.select("unit_id", "node_type").unionByName(gaps.select("unit_id", "node_type"))


@query(_RUNS + f" SELECT count(*) FILTER ({_KIND} <> 'queue') AS emitted, count(*) FILTER ({_KIND} = 'queue') AS gaps, round(count(*) FILTER ({_KIND} <> 'queue') / count(*), 3) AS ratio FROM un")
def emission_coverage(spark: SparkSession, d: str) -> DataFrame:
    """A-08: the share of units that became nodes."""
    return documents.emission_coverage(*documents.project_nodes(_odd_units(spark, d)))


@query(_RUNS + " SELECT 'system' AS system, count(*) AS n_nodes FROM un HAVING count(*) >= 2")
def system_node(spark: SparkSession, d: str) -> DataFrame:
    """A-10: one system over all nodes."""
    return documents.system_node(ad.run_units(spark, d))


@query("SELECT DISTINCT ['k8s-namespace:', 'k8s-database:', 'repo-root:', 'external-contract:'][o_orderkey % 5 + 1] || (o_custkey % 50) AS node_id, ['k8s-namespace', 'k8s-database', 'repo-root', 'external-contract'][o_orderkey % 5 + 1] AS prefix FROM orders WHERE o_orderkey % 5 < 4")
def synthetic_nodes(spark: SparkSession, d: str) -> DataFrame:
    """A-11: nodes that only edges name."""
    prefix = F.element_at(F.array(*(F.lit(x) for x in ("k8s-namespace:", "k8s-database:", "repo-root:", "external-contract:", "unit-"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return documents.synthetic_nodes(table(spark, d, "orders").select(_cat(prefix, F.col("o_custkey") % 50).alias("to_id")))


@query("SELECT l_suppkey AS unit_id, l_partkey % 20 AS port, arg_max('o' || l_orderkey, l_orderkey * 8 + l_linenumber) AS ref FROM lineitem GROUP BY ALL")
def unit_ports(spark: SparkSession, d: str) -> DataFrame:
    """A-12: ports of each unit, the last of repeated ones."""
    return documents.ports(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("unit_id"), (F.col("l_partkey") % 20).alias("port"), _cat("o", F.col("l_orderkey")).alias("ref"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord")))


@query("""WITH c(rule_id, control_id) AS (VALUES ('error', 'c1'), ('click', 'c1'), ('view', 'c2')) SELECT user_id AS unit_id, control_id, count(*) AS n_requirements, string_agg(DISTINCT event_type || (event_id % 3), '|' ORDER BY event_type || (event_id % 3)) AS signals FROM events JOIN c ON rule_id = event_type GROUP BY ALL""")
def control_requirements(spark: SparkSession, d: str) -> DataFrame:
    """A-13: what each control of a unit rests on."""
    controls = spark.createDataFrame([("error", "c1"), ("click", "c1"), ("view", "c2")], "rule_id string, control_id string")
    e = table(spark, d, "events").select(F.col("user_id").alias("unit_id"), F.col("event_type").alias("rule_id"), _cat(F.col("event_type"), F.col("event_id") % 3).alias("reference_name"))
    return documents.control_rows(e, controls)


_META = _RUNS + ", mu AS (SELECT unit_id, confidence, CASE WHEN confidence % 4 <> 0 THEN 'observed' END AS status FROM un)"


@query(_META + """ SELECT unit_id, 'x-aac-confidence' AS key, '' AS ord, CAST(confidence AS VARCHAR) AS value FROM mu UNION ALL SELECT unit_id, 'x-aac-run-version', '', '7' FROM mu UNION ALL SELECT unit_id, 'x-aac-status', '', status FROM mu WHERE status IS NOT NULL
UNION ALL SELECT DISTINCT from_id, 'x-aac-provenance', id, id FROM rel WHERE from_id IN (SELECT unit_id FROM mu)""")
def node_metadata(spark: SparkSession, d: str) -> DataFrame:
    """F-23: what is told of each node."""
    u = ad.run_units(spark, d).select("unit_id", "confidence", F.when(F.col("confidence") % 4 != 0, "observed").alias("status"))
    return documents.node_metadata(u, ad.run_relationships(spark, d).select(F.col("from_id").alias("unit_id"), F.col("id").alias("ref")), "7")


@query("SELECT 'x-aac-run-version' AS key, '' AS ord, '7' AS value UNION ALL SELECT 'x-aac-generated-at', '', 'now' UNION ALL SELECT 'x-aac-scope-limitations', '0000', 'static reading only' UNION ALL SELECT DISTINCT 'x-aac-package-roots', root, root FROM source_files")
def document_metadata(spark: SparkSession, d: str) -> DataFrame:
    """F-23: what is told of a document."""
    return documents.document_metadata(table(spark, d, "source_files").select("root"), "7", "now", ["static reading only"])


@query(_RUNS + """, nj AS (SELECT run, to_json(list({'unique-id': unit_id, 'node-type': kind, 'name': file} ORDER BY unit_id)) AS j FROM un WHERE confidence % 10 = 1 GROUP BY run), rj AS (SELECT run, to_json(list({'unique-id': id, 'from_id': from_id, 'to_id': to_id, 'kind': grade} ORDER BY id)) AS j FROM rel WHERE confidence = 1 GROUP BY run)
SELECT nj.run, '{"nodes":' || nj.j || CASE WHEN rj.j IS NULL THEN '' ELSE ',"relationships":' || rj.j END || '}' AS doc FROM nj LEFT JOIN rj ON rj.run = nj.run""")
def architecture_documents(spark: SparkSession, d: str) -> DataFrame:
    """K-01: the document of each run."""
    nodes = ad.run_units(spark, d).where("confidence % 10 = 1").select("run", "unit_id", F.col("kind").alias("node_type"), F.col("file").alias("name"))
    rel = ad.run_relationships(spark, d).where("confidence = 1").select("run", "id", "from_id", "to_id", F.col("grade").alias("kind"))
    return sinks.architecture_json(nodes, rel, "run")


@query(_RUNS + """ SELECT 'threat' AS module, '{"exact":"7/7"}' AS fitness, to_json({'run': run, 'unit_id': unit_id}) AS finding FROM un WHERE has_http AND NOT has_control""")
def module_reports(spark: SparkSession, d: str) -> DataFrame:
    """K-04: findings of a module with its fitness."""
    return sinks.module_report(ad.run_units(spark, d).where("has_http and not has_control").select("run", "unit_id"), "threat", {"exact": "7/7"})


@query(_RUNS + """, k AS (SELECT kind, count(*) AS n FROM un GROUP BY kind) SELECT 'Units' AS section, '0' AS line_ord, '## Units' AS line UNION ALL SELECT 'Units', '1', '| kind | n |' UNION ALL SELECT 'Units', '2', '|---|---|' UNION ALL SELECT 'Units', '3| ' || kind || ' | ' || n || ' |', '| ' || kind || ' | ' || n || ' |' FROM k""")
def notebook(spark: SparkSession, d: str) -> DataFrame:
    """K-05: a notebook's lines."""
    return sinks.notebook_lines({"Units": ad.run_units(spark, d).groupBy("kind").agg(F.count("*").alias("n"))})


_RES = "rs AS (SELECT DISTINCT override_id AS id, override_type AS trigger, CASE WHEN override_type LIKE 'rel%' THEN 'B' ELSE 'A' END AS tier, coalesce(module, 'none') AS class, CASE WHEN status = 'retired' THEN 'carried_forward' ELSE 'open' END AS status, decision_record_ref FROM overrides QUALIFY row_number() OVER (PARTITION BY override_id ORDER BY loaded_at DESC, status, override_type, decision_record_ref) = 1)"


def _residuals(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    one = F.row_number().over(Window.partitionBy("override_id").orderBy(F.desc("loaded_at"), F.asc_nulls_last("status"), F.asc_nulls_last("override_type"), F.asc_nulls_last("decision_record_ref")))
    o = table(spark, d, "overrides").withColumn("_n", one).where("_n = 1")
    t = F.col("override_type")
    return o.select(F.col("override_id").alias("id"), t.alias("trigger"), F.when(t.startswith("rel"), "B").otherwise("A").alias("tier"), F.coalesce("module", F.lit("none")).alias("class"), F.when(F.col("status") == "retired", "carried_forward").otherwise("open").alias("status"), "decision_record_ref").distinct()


@query(f"WITH {_RES} SELECT coalesce(trigger, '<no trigger>') AS trigger, min(tier) AS tier, count(*) AS total, count(*) FILTER (id IN (SELECT id FROM rs WHERE status = 'open' AND hash_ok)) AS decided FROM (SELECT *, ascii(right(id, 1)) % 2 = 0 AS hash_ok FROM rs) rs GROUP BY 1".replace("id IN (SELECT id FROM rs WHERE status = 'open' AND hash_ok)", "status = 'open' AND hash_ok"))
def residuals_by_trigger(spark: SparkSession, d: str) -> DataFrame:
    """A-17: residuals and how many are decided, by trigger."""
    r = _residuals(spark, d)
    done = r.where((F.col("status") == "open") & (F.ascii(F.substring("id", -1, 1)) % 2 == 0)).select(F.col("id").alias("residual_id"), F.lit("active").alias("status"))
    return review.residuals_by_trigger(r, done)


@query(_RUNS + f", {_RES} SELECT 'nodes' AS section, coalesce(CASE WHEN confidence % 10 <> 0 THEN kind END, 'unknown') AS key, count(*) AS n FROM un GROUP BY ALL UNION ALL SELECT 'relationships', grade, count(*) FROM rel GROUP BY ALL UNION ALL SELECT 'residuals', CASE status WHEN 'carried_forward' THEN 'carried' ELSE 'open' END, count(*) FROM rs GROUP BY ALL")
def notebook_counts(spark: SparkSession, d: str) -> DataFrame:
    """A-20: counts of the effective notebook."""
    nodes = ad.run_units(spark, d).select(F.when(F.col("confidence") % 10 != 0, F.col("kind")).alias("node_type"))
    return review.notebook_counts(nodes, ad.run_relationships(spark, d), _residuals(spark, d))


@query("""SELECT s_name AS package, s_name || ' | core | ' || CASE WHEN s_acctbal > 0 THEN 'true' ELSE 'false' END || ' | 1/' || coalesce(CASE WHEN s_suppkey % 3 <> 0 THEN CAST(s_suppkey % 5 AS VARCHAR) END, '-') || ' | - | ' || (s_suppkey % 2) || ' | 0' AS line FROM supplier""")
def scoreboard(spark: SparkSession, d: str) -> DataFrame:
    """A-21: one line for each package."""
    k = F.col("s_suppkey")
    none = F.lit(None).cast("int")
    return review.scoreboard(table(spark, d, "supplier").select(F.col("s_name").alias("package"), F.lit("core").alias("tier"), (F.col("s_acctbal") > 0).alias("pass"), F.lit(1).alias("node_precision"), F.when(k % 3 != 0, k % 5).alias("node_recall"), none.alias("interface_recall"), (k % 2).alias("relation_recall"), none.alias("violations")))


@query("SELECT CASE WHEN node_count IS NULL THEN 'not-applicable' WHEN (node_count % 2 = 0) <> (length(run_id) % 2 + 1 > 1) THEN 'refused' ELSE 'scored' END AS outcome, count(*) AS n FROM review_runs GROUP BY 1")
def exam_guard(spark: SparkSession, d: str) -> DataFrame:
    """F-24: exams that may be scored."""
    r = table(spark, d, "review_runs").select(review.exam_guard(F.col("node_count") % 2 == 0, F.length("run_id") % 2 + 1).alias("outcome"))
    return r.groupBy("outcome").agg(F.count("*").alias("n"))


# ---------------------------------------------------------------- review records


@query("SELECT l_orderkey, l_linenumber, 'R-' || CASE WHEN n < 1000 THEN lpad(CAST(n AS VARCHAR), 3, '0') ELSE CAST(n AS VARCHAR) END AS number FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber) - 1 AS n FROM lineitem)")
def residual_numbers(spark: SparkSession, d: str) -> DataFrame:
    """W-05: rows numbered within their flag, of which there are three."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return documents.number(li, ["l_returnflag"], ["l_orderkey", "l_linenumber"], "R-%03d", "number").select("l_orderkey", "l_linenumber", "number")


@query("WITH o AS (SELECT o_orderkey AS id, o_totalprice AS p, o_orderstatus = 'P' AS k FROM orders), r AS (SELECT id FROM o WHERE NOT k ORDER BY p DESC, id LIMIT 500) SELECT id, (SELECT count(*) - 500 FROM o WHERE NOT k) AS left_out FROM (SELECT id FROM o WHERE k UNION ALL SELECT id FROM r)")
def askable_cap(spark: SparkSession, d: str) -> DataFrame:
    """W-07, W-09: what is carried, and the five hundred greatest of the rest, with the number left out; the cap is the report's feature."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_totalprice", "o_orderstatus")
    kept, rest = review.rank_and_cap(o, F.col("o_orderstatus") == "P", 500, [F.desc("o_totalprice"), "id"])
    return kept.select("id").join(rest, F.lit(True))  # one row


@query("SELECT l_orderkey, l_linenumber, n AS rank, greatest(c - 3, 0) AS overflow FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber) AS n, count(*) OVER (PARTITION BY l_orderkey) AS c FROM lineitem) WHERE n <= 3")
def top_options(spark: SparkSession, d: str) -> DataFrame:
    """W-10: the three dearest lines of each order and how many follow."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return review.top_options(li, ["l_orderkey"], [F.desc("l_extendedprice"), "l_linenumber"], 3).select("l_orderkey", "l_linenumber", "rank", "overflow")


@query("SELECT DISTINCT decision_id, trim(domain) AS domain, array_to_string(list_sort(list_distinct(evidence_refs)), '|') AS refs FROM decisions")
def canonical_decisions(spark: SparkSession, d: str) -> DataFrame:
    """W-12: decisions in the form in which they are compared."""
    rows = documents.canonical_rows(table(spark, d, "decisions").select("decision_id", "domain", "evidence_refs"), ["decision_id"])
    return rows.select("decision_id", "domain", F.array_join("evidence_refs", "|").alias("refs")).distinct()


@query(None)
def greedy_pairs(spark: SparkSession, d: str) -> DataFrame:
    """W-13, A-16: one-to-one matches of lines and parts within a supplier, the dearest first. SQL has no greedy order; the tests hold it against a loop."""
    li = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("package"), F.col("l_orderkey").alias("gold"), F.col("l_partkey").alias("found"), F.col("l_extendedprice").alias("score"))
    return documents.greedy_match(li)


@query(None)
def applied_overrides(spark: SparkSession, d: str) -> DataFrame:
    """U-04: nodes after the overrides of each domain, with provenance. SQL would need the same scans; the tests hold it against known cases."""
    o = table(spark, d, "overrides").distinct().select(F.coalesce("domain", F.lit("none")).alias("arch_id"), F.col("loaded_at").alias("ord"), "override_id", "override_type", "target_ref", "new_value", "status", "decision_record_ref")
    nodes = table(spark, d, "calm_elements").where("element_kind = 'node'").select(F.lit("none").alias("arch_id"), F.col("element_id").alias("node_id"), F.lit("service").alias("node_type"), F.col("element_id").alias("name"), F.lit(None).cast("string").alias("container")).distinct()
    rel = table(spark, d, "calm_elements").where("element_kind = 'relationship'").select(F.lit("none").alias("arch_id"), F.col("element_id").alias("rel_id"), F.lit("a").alias("from_id"), F.lit("b").alias("to_id")).distinct()
    return documents.apply_overrides(nodes, rel, o, table(spark, d, "decisions").select("decision_id", "status"))[0]


@query("""WITH a AS (SELECT o_orderpriority AS tier, o_custkey % 7 AS class, min(o_orderstatus) AS answer FROM orders WHERE o_orderkey % 50 = 0 AND (o_orderkey % 3 = 0 OR o_orderkey % 3 = 1) GROUP BY ALL HAVING count(DISTINCT o_orderstatus) = 1) SELECT o_orderkey AS id, answer FROM orders JOIN a ON a.tier = o_orderpriority AND a.class = o_custkey % 7""")
def bulk_answers(spark: SparkSession, d: str) -> DataFrame:
    """U-06: answers of anchors copied to all of their tier and class."""
    o = table(spark, d, "orders")
    keyed = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("tier"), (F.col("o_custkey") % 7).alias("class"), F.col("o_orderstatus").alias("answer"))
    m = F.col("id") % 3
    anchors = keyed.where("id % 50 = 0").withColumn("override_type", F.when(m == 1, "type_change").when(m == 2, "node_remove"))
    return review.bulk_replicate(anchors, keyed.drop("answer"), ["tier", "class"]).select("id", "answer")


@query(_RUNS + " SELECT id, 'draft' AS state FROM rel WHERE NOT coalesce(confidence < 30, false)")
def preview_diff(spark: SparkSession, d: str) -> DataFrame:
    """U-07: relationships that the merged document has and the other has not."""
    rel = ad.run_relationships(spark, d).select("id", "confidence")
    return review.preview(rel, rel.where("confidence < 30"), "id").select("id", "state")


@query("""WITH p AS (SELECT reference_name AS ref, 0 AS o, 'decorator' AS src FROM raw_facts WHERE match_source = 'decorator' UNION ALL SELECT reference_name, 1, 'call' FROM raw_facts WHERE match_source = 'call' UNION ALL SELECT DISTINCT from_node_name, 2, 'node' FROM raw_facts WHERE from_node_name IS NOT NULL)
SELECT ref, arg_min(src, o) AS src FROM p WHERE ref NOT IN (SELECT reference_name FROM raw_facts WHERE language = 'python') GROUP BY ref""")
def leftover_references(spark: SparkSession, d: str) -> DataFrame:
    """U-09, W-11: references that nobody claimed, each from the first list that has it."""
    f = table(spark, d, "raw_facts")
    part = lambda df, c, src: df.select(F.col(c).alias("ref"), F.lit(src).alias("src")).distinct()
    parts = [part(f.where("match_source = 'decorator'"), "reference_name", "decorator"), part(f.where("match_source = 'call'"), "reference_name", "call"), part(f.where("from_node_name is not null"), "from_node_name", "node")]
    return review.leftovers(parts, f.where("language = 'python'").select(F.col("reference_name").alias("ref")), "ref")


@query(f"""WITH {_RES}, op AS (SELECT id, o, 'option ' || o AS label FROM rs, unnest(range(1, 1 + ascii(right(id, 1)) % 14)) AS u(o)), tx AS (SELECT id, string_agg(o || '. ' || label, chr(10) ORDER BY o) FILTER (o <= 10) AS t, greatest(count(*) - 10, 0) AS more FROM op GROUP BY id)
SELECT rs.id, CASE WHEN status = 'carried_forward' THEN '### ' || rs.id || ' (carried forward)' || chr(10) || chr(10) || 'about ' || rs.id ELSE '### ' || rs.id || ' (' || tier || ', ' || class || ')' || chr(10) || chr(10) || 'about ' || rs.id || chr(10) || chr(10) || coalesce(t || CASE WHEN more > 0 THEN chr(10) || '(+' || more || ' more)' ELSE '' END, 'none of these') END AS card FROM rs LEFT JOIN tx ON tx.id = rs.id""")
def session_cards(spark: SparkSession, d: str) -> DataFrame:
    """K-07: the card of each residual."""
    r = _residuals(spark, d).withColumn("rationale", _cat("about ", F.col("id")))
    n = F.ascii(F.substring("id", -1, 1)) % 14
    o = r.select("id", F.explode(F.when(n > 0, F.sequence(F.lit(1), n))).alias("option_ord")).withColumn("label", _cat("option ", F.col("option_ord")))
    return review.session_cards(r, o)


@query("""WITH l AS (SELECT CASE WHEN status = 'active' THEN 'applied' ELSE 'skipped' END AS outcome FROM overrides) SELECT '1' || outcome AS line_ord, '- ' || outcome || ': ' || count(*) AS line FROM l GROUP BY outcome
UNION ALL SELECT '2' || t, '  - [A] ' || t || ': 0/' || n FROM (SELECT coalesce(override_type, '<no trigger>') AS t, count(DISTINCT override_id) AS n FROM overrides GROUP BY 1)""")
def apply_report(spark: SparkSession, d: str) -> DataFrame:
    """K-07: the report of an application."""
    o = table(spark, d, "overrides")
    log = o.select("override_id", F.when(F.col("status") == "active", "applied").otherwise("skipped").alias("outcome"))
    residuals = o.select(F.col("override_id").alias("id"), F.col("override_type").alias("trigger"), F.lit("A").alias("tier")).distinct()
    return review.apply_report(log, review.residuals_by_trigger(residuals, spark.createDataFrame([], "residual_id string, status string")))


@query("SELECT 'https://controls.invalid/' || id AS url, 'rules/' || id || '.json' AS path FROM (VALUES " + ", ".join(f"('{c[0]}')" for c in catalog.CONTROLS) + ") AS t(id)")
def control_map(spark: SparkSession, d: str) -> DataFrame:
    """K-08: where the requirement of each control lies."""
    c = catalog.controls(spark)
    return review.control_map(c.select("control_id", _cat("https://controls.invalid/", F.col("control_id")).alias("url")), c.select("control_id", _cat("rules/", F.col("control_id"), ".json").alias("path")))


def _sql_five() -> str:
    """The five rules as nested SQL, from the one list of them."""
    out = "text"
    for pattern, new in fn.FIVE_RULES:
        quoted = pattern.replace("'", "''")
        for i in (1, 2, 3):
            new = new.replace(f"${i}", f"\\{i}")
        out = f"regexp_replace({out}, '{quoted}', '{new}', 'g')"
    return out


@query(f"SELECT DISTINCT root, file, line, {_sql_five()} AS text FROM source_lines WHERE text IS NOT NULL")
def redact_five(spark: SparkSession, d: str) -> DataFrame:
    """The five rules of the review's redaction, in every line."""
    return table(spark, d, "source_lines").where("text is not null").select("root", "file", "line", fn.redact_five(F.col("text")).alias("text")).distinct()
