"""Queries of the evidence pipeline over the tables at hand, each next to SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.functions import text as fn
from gristmill.operators import catalog, correlate, evidence, relations, review, runs
from gristmill.session import table
from gristmill.sources import trees

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query, with its SQL if it has any."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_facts").distinct()


_RULES = ", ".join(f"({i}, '{r[0]}', '{r[1]}', '{r[2]}', '(?i)\\b{re.escape(s)}\\b', '{r[4]}', {r[5]})" for i, r in enumerate(catalog.SIGNAL_RULES) for s in r[3].split("|"))
_MATCHED = f"""WITH r(rule_ord, rule_id, lang, src, pattern, category, weight) AS (VALUES {_RULES}),
f AS (SELECT DISTINCT * FROM raw_facts),
k AS (SELECT s, ms, l, min(rule_ord) AS rule_ord FROM (SELECT DISTINCT reference_name AS s, match_source AS ms, language AS l FROM raw_facts) x
  JOIN r ON r.src = x.ms AND (x.l IS NULL OR x.l = r.lang) AND regexp_matches(x.s, r.pattern) GROUP BY s, ms, l),
m AS (SELECT f.*, q.rule_id, q.category, q.weight FROM f LEFT JOIN k ON f.reference_name = k.s AND f.match_source = k.ms AND f.language IS NOT DISTINCT FROM k.l
  LEFT JOIN (SELECT DISTINCT rule_ord, rule_id, category, weight FROM r) q ON q.rule_ord = k.rule_ord)"""
_BAND = "CASE WHEN confidence >= 70 THEN 'high' WHEN confidence >= 40 THEN 'medium' ELSE 'low' END"
_UNITS = (
    _MATCHED
    + f""", g AS (SELECT root, file, count(*) AS n_evidence, CAST(least(100, sum(weight)) AS BIGINT) AS confidence, CAST(min(line) AS BIGINT) AS start_line, CAST(max(line) AS BIGINT) AS end_line,
  bool_or(category IN ('http-entry-point', 'serverless-entry-point')) AS e, bool_or(category = 'persistence') AS p, bool_or(category = 'messaging') AS t,
  count(DISTINCT CASE WHEN from_node_kind = 'class' THEN from_node_name END) AS nc, min(CASE WHEN from_node_kind = 'class' THEN from_node_name END) AS c
  FROM m WHERE rule_id IS NOT NULL GROUP BY root, file),
u AS (SELECT root, file, n_evidence, confidence, start_line, end_line, {_BAND} AS band, CASE WHEN e THEN 'service' WHEN p THEN 'database' WHEN t THEN 'topic' ELSE 'service' END AS kind,
  CASE WHEN nc = 1 THEN c ELSE regexp_replace(regexp_extract(file, '([^/]*)$', 1), '(.)\\.[^.]*$', '\\1') END AS name FROM g)"""
)
_TEST = "(regexp_matches(file, '(^|[/\\\\])(test|tests|__tests__)([/\\\\]|$)') OR regexp_matches(regexp_extract(file, '([^/\\\\]*)$', 1), 'Tests?\\.java$|^test_.*\\.py$|_test\\.py$|\\.test\\.tsx?$|\\.spec\\.tsx?$'))"


def units(spark: SparkSession, d: str) -> DataFrame:
    """Scored units of all facts, by file."""
    named = F.when(F.col("from_node_kind") == "class", F.col("from_node_name"))
    return evidence.rollup(evidence.match_signals(_facts(spark, d)), ["root", "file"], class_name=named, path="file")


@query(_UNITS + " SELECT * FROM u")
def evidence_rollup(spark: SparkSession, d: str) -> DataFrame:
    """J-01, A-01, A-02, F-07..F-09: every file's units with confidence, band, kind and name."""
    return units(spark, d)


_NATIVE = """SELECT DISTINCT root, file, CAST(line AS INTEGER) AS start_line, CASE WHEN lower(v) = 'route' THEN 'GET' ELSE upper(v) END || ' /' || regexp_replace(p, '^/', '') AS name FROM (
SELECT *, CASE WHEN file LIKE '%.py' THEN regexp_extract(text, '^\\s*@(?:app|router|\\w+)\\.(get|post|put|patch|delete|route)\\(\\s*["'']([^"'']*)["'']', 1) ELSE regexp_extract(text, '^\\s*@(Get|Post|Put|Patch|Delete)(?:Mapping)?\\(\\s*["'']([^"'']*)["'']', 1) END AS v,
CASE WHEN file LIKE '%.py' THEN regexp_extract(text, '^\\s*@(?:app|router|\\w+)\\.(get|post|put|patch|delete|route)\\(\\s*["'']([^"'']*)["'']', 2) ELSE regexp_extract(text, '^\\s*@(Get|Post|Put|Patch|Delete)(?:Mapping)?\\(\\s*["'']([^"'']*)["'']', 2) END AS p
FROM source_lines WHERE regexp_matches(file, '\\.(py|ts|java)$')) WHERE v <> ''"""


@query(_MATCHED + f""", nr AS ({_NATIVE}), x AS (SELECT reference_name, ord FROM m WHERE rule_id IS NULL AND NOT (match_source = 'decorator' AND from_node_kind = 'method' AND EXISTS (SELECT 1 FROM nr WHERE nr.root = m.root AND nr.file = m.file AND nr.start_line = m.line))),
n AS (SELECT reference_name, count(*) AS n FROM x GROUP BY reference_name ORDER BY n DESC, reference_name LIMIT 100)
SELECT n.reference_name, n.n, (SELECT string_agg(CAST(ord AS VARCHAR), ',' ORDER BY ord) FROM (SELECT ord FROM x WHERE x.reference_name = n.reference_name ORDER BY ord LIMIT 5)) AS samples FROM n""")
def unmatched_signals(spark: SparkSession, d: str) -> DataFrame:
    """A-07, J-02: names without a rule, less those that a native route on their line explains: the most frequent hundred with five samples each."""
    rest = evidence.match_signals(_facts(spark, d)).where("rule_id is null")
    rest = evidence.suppress_route_lines(rest, trees.native_routes(table(spark, d, "source_lines")))
    return evidence.clusters(rest, "reference_name", ["ord"], F.col("ord").cast("string"))


@query(_UNITS + " SELECT CASE WHEN confidence >= 40 THEN 'kept' ELSE 'INSUFFICIENT_EVIDENCE' END AS outcome, kind, band, count(*) AS n FROM u GROUP BY ALL")
def confidence_floor_split(spark: SparkSession, d: str) -> DataFrame:
    """F-05: units kept and ignored by reason."""
    kept, low = evidence.floor_split(units(spark, d))
    both = kept.select(F.lit("kept").alias("outcome"), "kind", "band").unionByName(low.select(F.col("reason").alias("outcome"), "kind", "band"))
    return both.groupBy("outcome", "kind", "band").agg(F.count("*").alias("n"))


@query(f"SELECT root, CASE WHEN {_TEST} THEN 'TEST_CODE' ELSE 'product' END AS outcome, count(*) AS n FROM (SELECT DISTINCT root, file FROM source_files) GROUP BY ALL")
def test_path_split(spark: SparkSession, d: str) -> DataFrame:
    """F-01: files of product and of test code."""
    product, test = evidence.split_test_paths(table(spark, d, "source_files").select("root", "file").distinct())
    both = product.select("root", F.lit("product").alias("outcome")).unionByName(test.select("root", F.lit("TEST_CODE").alias("outcome")))
    return both.groupBy("root", "outcome").agg(F.count("*").alias("n"))


@query("SELECT root, ext, language, count(*) AS n FROM (SELECT DISTINCT * FROM source_files) GROUP BY ALL")
def counts_by_key(spark: SparkSession, d: str) -> DataFrame:
    """A-03: files by extension and language."""
    return table(spark, d, "source_files").distinct().groupBy("root", "ext", "language").agg(F.count("*").alias("n"))


@query("""SELECT root, CAST(sum(len(regexp_extract_all(coalesce(text, ''), '@app\\.route\\(|@router\\.(?:get|post|put|patch|delete)\\(|@Controller\\(|@(?:Get|Post|Put|Patch|Delete)\\('))) AS BIGINT) AS n_hits
FROM (SELECT DISTINCT root, file, line, text FROM source_lines) WHERE regexp_matches(file, '\\.(py|ts)$') GROUP BY root""")
def route_smoke_test(spark: SparkSession, d: str) -> DataFrame:
    """S-21: text that looks like a route."""
    return evidence.smoke_counts(table(spark, d, "source_lines").select("root", "file", "line", "text").distinct().na.fill("", ["text"]))


@query("""SELECT root, file, CAST(line AS INTEGER) AS line, qualified, regexp_extract(qualified, '([^.]+)$', 1) AS bare FROM (SELECT DISTINCT root, file, line, regexp_extract(text, '^\\s*import\\s+(?:static\\s+)?([A-Za-z_][\\w.]*)\\s*;', 1) AS qualified FROM source_lines) WHERE qualified <> ''""")
def java_imports(spark: SparkSession, d: str) -> DataFrame:
    """S-22: import lines."""
    return evidence.java_imports(table(spark, d, "source_lines"))


@query("""SELECT o.o_orderkey, count(DISTINCT l_suppkey) AS n_candidates, CASE WHEN count(DISTINCT l_suppkey) = 1 THEN min(l_suppkey) END AS l_suppkey,
CASE count(DISTINCT l_suppkey) WHEN 1 THEN 'resolved' WHEN 0 THEN 'zero' ELSE 'ambiguous' END AS outcome FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY o.o_orderkey""")
def cardinality_gate(spark: SparkSession, d: str) -> DataFrame:
    """J-07: orders with exactly one supplier."""
    o = table(spark, d, "orders").select("o_orderkey")
    j = o.join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey"), "o_orderkey", "left")
    return evidence.exactly_one(j, ["o_orderkey"], "l_suppkey")


_EDGES = "e AS (SELECT o_custkey, l_suppkey, min(l_orderkey * 8 + l_linenumber) AS ord FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL)"


def _trade_edges(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    e = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", "l_linenumber").join(o, "l_orderkey")
    return e.groupBy("o_custkey", "l_suppkey").agg(F.min(F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("ord"))


def _trade(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Edges customer -> supplier; customers in debt and suppliers in debt are nodes without a unit."""
    c, s = table(spark, d, "customer"), table(spark, d, "supplier")
    e = _trade_edges(spark, d).select(F.concat(F.lit("c"), "o_custkey").alias("source"), F.concat(F.lit("s"), "l_suppkey").alias("target"), F.when(F.col("ord") % 2 == 0, "calls").otherwise("references").alias("relation"), "ord")
    both = c.select(F.concat(F.lit("c"), "c_custkey").alias("unit_id"), F.col("c_nationkey").alias("root"), F.col("c_acctbal").alias("bal")).unionByName(s.select(F.concat(F.lit("s"), "s_suppkey").alias("unit_id"), F.col("s_nationkey").alias("root"), F.col("s_acctbal").alias("bal")))
    units_ = both.where("bal >= 0")
    return e, units_.select(F.col("unit_id").alias("node_id"), "unit_id"), units_.select("unit_id", "root"), both


_TRADE = f"""WITH {_EDGES}, x AS (SELECT 'c' || o_custkey AS source, 's' || l_suppkey AS target, CASE WHEN ord % 2 = 0 THEN 'calls' ELSE 'references' END AS relation, ord FROM e),
b AS (SELECT 'c' || c_custkey AS id, c_nationkey AS root, c_acctbal AS bal FROM customer UNION ALL SELECT 's' || s_suppkey, s_nationkey, s_acctbal FROM supplier), u AS (SELECT * FROM b WHERE bal >= 0),
j AS (SELECT x.*, a.id AS from_id, z.id AS to_id, a.root AS ra, z.root AS rb FROM x LEFT JOIN u a ON a.id = x.source LEFT JOIN u z ON z.id = x.target),
rel AS (SELECT from_id, to_id, CASE relation WHEN 'calls' THEN 'calls' ELSE 'connects' END AS kind, ra <> rb AS "cross", min(ord) AS ord FROM j WHERE from_id IS NOT NULL AND to_id IS NOT NULL GROUP BY ALL)"""


@query(_TRADE + ' SELECT from_id, to_id, kind, "cross", ord FROM rel')
def reconcile_edges(spark: SparkSession, d: str) -> DataFrame:
    """J-05: edges between units."""
    e, nodes, roots, _ = _trade(spark, d)
    return relations.reconcile(e, nodes, roots)[0].select("from_id", "to_id", "kind", "cross", "ord")


@query(_TRADE + " SELECT source, target, coalesce(from_id, 'unresolved:' || source) AS from_id, coalesce(to_id, 'unresolved:' || target) AS to_id, ord FROM j WHERE (from_id IS NULL) <> (to_id IS NULL)")
def admitted_unresolved(spark: SparkSession, d: str) -> DataFrame:
    """J-06: edges with one unknown end."""
    e, nodes, roots, _ = _trade(spark, d)
    half = relations.reconcile(e, nodes, roots)[1]
    return relations.admit_unresolved(half, half.where("false"))[0]


@query(_TRADE + """ SELECT 'architecture' AS grade, 'inferred' AS status, kind || '|' || from_id || '|' || to_id || '|graph' AS id, "cross", CASE WHEN "cross" THEN 10 ELSE 15 END AS confidence FROM rel""")
def grade_and_identity(spark: SparkSession, d: str) -> DataFrame:
    """F-14, F-16, trust tiers and content-made ids of the reconciled edges; customers are services, suppliers stores."""
    rel = reconcile_edges(spark, d).withColumn("mechanism", F.lit("r2-phase1"))
    trusted = catalog.with_trust(rel, spark).withColumn("mechanism", F.lit(None).cast("string")).withColumn("source", F.lit("graph"))
    g = relations.grade(F.col("kind"), F.col("source"), F.lit("service"), F.lit("database"))
    s = relations.relationship_status(F.col("source"), F.col("mechanism"), F.lit(False), F.col("confidence"))
    return relations.with_identity(trusted).select(g.alias("grade"), s.alias("status"), "id", "cross", "confidence")


@query("""SELECT o_custkey, l_suppkey, count(*) AS n_merged, string_agg(DISTINCT l_returnflag, '|' ORDER BY l_returnflag) AS l_returnflag, string_agg(DISTINCT l_linestatus, '|' ORDER BY l_linestatus) AS l_linestatus
FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def duplicate_edge_merge(spark: SparkSession, d: str) -> DataFrame:
    """A-09: one edge for each pair, its values joined."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    return relations.merge_duplicates(table(spark, d, "lineitem").join(o, "l_orderkey"), ["o_custkey", "l_suppkey"], ["l_returnflag", "l_linestatus"])


@query("""WITH imp AS (SELECT DISTINCT l_orderkey AS bridge, l_suppkey AS impl FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_acctbal < 1500),
st AS (SELECT s_suppkey AS impl, s_acctbal < 0 AS stereo FROM supplier WHERE s_acctbal < 500),
rc AS (SELECT s_suppkey AS impl, s_nationkey AS store FROM supplier WHERE s_acctbal >= 500 AND s_acctbal < 1200),
ow AS (SELECT DISTINCT l_orderkey AS bridge, l_partkey AS store FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size <= 5),
i AS (SELECT bridge, count(*) AS n, min(imp.impl) AS impl, count(st.impl) AS ns, min(st.impl) AS simpl, count(*) FILTER (stereo) AS nt, min(st.impl) FILTER (stereo) AS timpl FROM imp LEFT JOIN st ON st.impl = imp.impl GROUP BY bridge),
h AS (SELECT impl, count(DISTINCT store) AS n, min(store) AS store FROM rc GROUP BY impl), q AS (SELECT bridge, count(DISTINCT store) AS n, min(store) AS store FROM ow GROUP BY bridge),
j AS (SELECT o_custkey AS service, o_orderkey AS bridge, coalesce(i.n, 0) AS n, i.impl, i.ns, i.simpl, i.nt, i.timpl, coalesce(h.n, 0) AS nr, h.store AS reach, coalesce(q.n, 0) AS no, q.store AS own
  FROM orders LEFT JOIN i ON i.bridge = o_orderkey LEFT JOIN h ON h.impl = i.impl LEFT JOIN q ON q.bridge = o_orderkey)
SELECT service, bridge, CASE WHEN n = 1 AND ns = 1 THEN 'r2-phase1' WHEN n = 1 AND nr = 1 THEN 'r2b' WHEN n = 0 AND no = 1 THEN 'r2c' WHEN n >= 2 AND nt = 1 THEN 'r2-stereotype' WHEN n >= 2 AND ns = 1 THEN 'tier-b' ELSE 'unresolved' END AS mechanism,
CAST(CASE WHEN n = 1 AND ns = 1 THEN impl WHEN n = 1 AND nr = 1 THEN reach WHEN n = 0 AND no = 1 THEN own WHEN n >= 2 AND nt = 1 THEN timpl WHEN n >= 2 AND ns = 1 THEN simpl END AS VARCHAR) AS target FROM j""")
def bridge_two_hop(spark: SparkSession, d: str) -> DataFrame:
    """J-08: customers through orders to stores; suppliers implement, parts are fallback stores."""
    li, s = table(spark, d, "lineitem"), table(spark, d, "supplier")
    near = s.where("s_acctbal < 1500").select(F.col("s_suppkey").alias("impl"))
    imp = li.select(F.col("l_orderkey").alias("bridge"), F.col("l_suppkey").alias("impl")).join(near, "impl", "left_semi")
    stores = s.where("s_acctbal < 500").select(F.col("s_suppkey").alias("impl"), (F.col("s_acctbal") < 0).alias("stereotype"))
    reach = s.where("s_acctbal >= 500 and s_acctbal < 1200").select(F.col("s_suppkey").alias("impl"), F.col("s_nationkey").alias("store"))
    small = table(spark, d, "part").where("p_size <= 5").select(F.col("p_partkey").alias("store"))
    own = li.select(F.col("l_orderkey").alias("bridge"), F.col("l_partkey").alias("store")).join(small, "store", "left_semi")
    hops = table(spark, d, "orders").select(F.col("o_custkey").alias("service"), F.col("o_orderkey").alias("bridge"))
    return relations.resolve_bridges(hops, imp, stores, reach, own)


@query("""WITH f AS (SELECT DISTINCT root, file, line, ord, from_node_kind, from_node_id, from_node_name, reference_name, argument, upper(regexp_extract(reference_name, '^(?i:(get|post|put|patch|delete))(?:Mapping)?$', 1)) AS verb FROM raw_facts WHERE match_source = 'decorator'),
w AS (SELECT *, last_value(CASE WHEN from_node_kind = 'class' AND reference_name IN ('Controller', 'Path', 'RequestMapping') THEN argument END IGNORE NULLS) OVER (PARTITION BY root, file ORDER BY line, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base FROM f),
o AS (SELECT root, file, from_node_id, from_node_name, arg_min(argument, (line, ord)) AS own FROM f WHERE from_node_kind = 'method' AND reference_name = 'Path' AND argument IS NOT NULL GROUP BY ALL),
r AS (SELECT w.root, w.file, w.line, w.ord, w.verb, nullif(trim(w.base, '/'), '') AS b, nullif(trim(coalesce(w.argument, o.own), '/'), '') AS p FROM w LEFT JOIN o USING (root, file, from_node_id, from_node_name) WHERE w.from_node_kind = 'method' AND w.verb <> '' AND w.base IS NOT NULL)
SELECT root, file, CAST(line AS BIGINT) AS line, ord, verb, verb || ' /' || concat_ws('/', b, p) AS route FROM r""")
def route_composition_asof(spark: SparkSession, d: str) -> DataFrame:
    """J-03, W-01: the verbs of all methods under the nearest class path before them in the file."""
    f = _facts(spark, d).where("match_source = 'decorator'").select("root", "file", "line", "ord", "from_node_kind", "from_node_id", "from_node_name", "reference_name", "argument").distinct()
    return evidence.compose_routes(f)[0].withColumn("line", F.col("line").cast("bigint"))


@query("""SELECT user_id, event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS signup_id FROM events
QUALIFY event_type = 'purchase'""")
def event_asof(spark: SparkSession, d: str) -> DataFrame:
    """J-03 on events: each purchase with the last signup of its user before it."""
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    w = evidence.nearest_preceding(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_id"), "signup_id")
    return w.where("event_type = 'purchase'").select("user_id", "event_id", "signup_id")


@query("""SELECT l_orderkey, l_linenumber, l_returnflag FROM (SELECT *, rank() OVER (PARTITION BY l_orderkey ORDER BY CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN 1 ELSE 2 END) AS p FROM lineitem) WHERE p = 1""")
def best_tier_evidence(spark: SparkSession, d: str) -> DataFrame:
    """W-02: of each order the lines at its best flag."""
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    flag = F.col("l_returnflag")
    return evidence.best_tier(li, ["l_orderkey"], F.when(flag == "R", 0).when(flag == "A", 1).otherwise(2))


@query("""WITH s AS (SELECT s_suppkey, s_nationkey AS n, n_regionkey AS r, CAST(floor(s_acctbal / 500) AS BIGINT) AS b FROM supplier JOIN nation ON n_nationkey = s_nationkey),
c AS (SELECT c_custkey, c_nationkey AS n, n_regionkey AS r, CAST(floor(c_acctbal / 500) AS BIGINT) AS b FROM customer JOIN nation ON n_nationkey = c_nationkey)
SELECT tier, count(*) AS n_pairs FROM (SELECT CASE WHEN s.n = c.n THEN 'nation' WHEN s.r = c.r THEN 'region' ELSE 'balance' END AS tier FROM s JOIN c ON s.n = c.n OR s.r = c.r OR s.b = c.b) GROUP BY tier""")
def ranked_tier_join(spark: SparkSession, d: str) -> DataFrame:
    """J-20: supplier-customer pairs by their first tier: same nation, same region, same balance."""
    n = table(spark, d, "nation").select("n_nationkey", "n_regionkey")
    s = table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_nationkey").alias("n"), F.col("n_regionkey").alias("r"), F.floor(F.col("s_acctbal") / 500).alias("b"))
    c = table(spark, d, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_nationkey").alias("n"), F.col("n_regionkey").alias("r"), F.floor(F.col("c_acctbal") / 500).alias("b"))
    return correlate.tier_counts(s, c, [(name, [F.col(k)], [F.col(k)]) for name, k in (("nation", "n"), ("region", "r"), ("balance", "b"))])


_NAMES = ["ring", "Small-Ring", "widget", "plate", "bolt", "large gear"]


@query("""WITH v(name, o) AS (VALUES """ + ", ".join(f"('{x}', {i})" for i, x in enumerate(_NAMES)) + """), f AS (SELECT DISTINCT p_name, regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS k FROM part),
w AS (SELECT name, o, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS k FROM v),
b AS (SELECT f.p_name, arg_min(w.name, CAST(w.k <> f.k AS INTEGER) * 1000 + w.o) AS match FROM f JOIN w ON length(w.k) >= 3 AND length(f.k) >= 3 AND (contains(f.k, w.k) OR contains(w.k, f.k)) GROUP BY f.p_name)
SELECT part.p_partkey, b.match FROM part LEFT JOIN b ON b.p_name = part.p_name""")
def substring_correlation(spark: SparkSession, d: str) -> DataFrame:
    """J-15: parts and deployment names that hold each other."""
    names = spark.createDataFrame([(x, i) for i, x in enumerate(_NAMES)], "name string, o int")
    return correlate.contained_name(table(spark, d, "part"), "p_name", names, "name", "o").select("p_partkey", "match")


@query("""WITH g AS (SELECT l_orderkey AS secret, l_suppkey AS member, bool_or(l_returnflag = 'R') AS i FROM lineitem GROUP BY ALL), o AS (SELECT secret, min(member) FILTER (i) AS issuer FROM g GROUP BY secret HAVING count(*) >= 2 AND count(*) FILTER (i) = 1)
SELECT g.secret, o.issuer, g.member AS verifier FROM g JOIN o ON o.secret = g.secret WHERE NOT g.i""")
def shared_secret_trust(spark: SparkSession, d: str) -> DataFrame:
    """J-16: an order's suppliers share it; the only one with a return issues."""
    return correlate.shared_secret_edges(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("secret"), F.col("l_suppkey").alias("member"), (F.col("l_returnflag") == "R").alias("is_issuer")))


@query("""SELECT o_orderkey AS key, o_orderstatus AS claim, CASE WHEN coalesce(bool_or(l_linestatus = o_orderstatus), false) THEN 'agree' WHEN count(DISTINCT l_linestatus) = 1 THEN 'contradiction' WHEN count(DISTINCT l_linestatus) > 1 THEN 'ambiguous' ELSE 'no-signal' END AS outcome
FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL""")
def contradiction(spark: SparkSession, d: str) -> DataFrame:
    """J-19: an order's status against its lines."""
    claims = table(spark, d, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("claim"))
    return correlate.contradictions(claims, table(spark, d, "lineitem").select(F.col("l_orderkey").alias("key"), F.col("l_linestatus").alias("value")))


@query("SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)")
def relational_division(spark: SparkSession, d: str) -> DataFrame:
    """J-24: customers with orders of every priority."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority")
    return correlate.divide(o, "o_custkey", "o_orderpriority", o.select("o_orderpriority"))


_MERGE = """WITH e AS (SELECT o_custkey, o_orderstatus, o_orderpriority, o_orderdate, (SELECT min(o_orderdate) + (max(o_orderdate) - min(o_orderdate)) / 2 FROM orders) AS mid FROM orders),
p AS (SELECT o_custkey AS id, string_agg(DISTINCT o_orderstatus, ';' ORDER BY o_orderstatus) AS sig, CASE WHEN count(*) > 5 THEN 'reviewed' ELSE 'inferred' END AS status FROM e WHERE o_orderdate < mid GROUP BY o_custkey),
f AS (SELECT o_custkey AS id, string_agg(DISTINCT o_orderstatus, ';' ORDER BY o_orderstatus) AS sig, CASE WHEN count(*) > 5 THEN 'observed' ELSE 'inferred' END AS status FROM e WHERE o_orderdate >= mid GROUP BY o_custkey),
m AS (SELECT coalesce(p.id, f.id) AS id, CASE WHEN p.id IS NULL THEN 'new' WHEN f.id IS NULL THEN 'disappeared' WHEN p.sig = f.sig THEN 'unaffected' WHEN p.status = 'reviewed' THEN 'flagged' ELSE 'changed' END AS outcome,
  CASE WHEN p.id IS NULL THEN 'new' ELSE p.status END AS from_status, CASE WHEN f.id IS NULL THEN 'disappeared' WHEN p.id IS NULL THEN f.status WHEN p.sig = f.sig THEN p.status WHEN p.status = 'reviewed' THEN 'requires-review' ELSE f.status END AS to_status FROM p FULL JOIN f ON p.id = f.id)"""


def _merged(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderdate")
    span = e.agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b")).select(F.expr("a + (b - a) / 2").alias("mid"))
    e = e.join(F.broadcast(span), F.lit(True))  # one row
    sig = F.array_join(F.array_sort(F.collect_set("o_orderstatus")), ";")
    side = lambda rows, much: rows.groupBy(F.col("o_custkey").alias("id")).agg(F.when(F.count("*") > 5, much).otherwise("inferred").alias("status"), sig.alias("sig"))
    return runs.incremental_merge(side(e.where("o_orderdate < mid"), "reviewed"), side(e.where("o_orderdate >= mid"), "observed"))


@query(_MERGE + " SELECT * FROM m")
def incremental_merge(spark: SparkSession, d: str) -> DataFrame:
    """U-03: customers of the first half of all orders against those of the second."""
    return _merged(spark, d)


@query(_MERGE + " SELECT outcome, from_status, to_status, count(*) AS n FROM m WHERE outcome IN ('new', 'disappeared', 'flagged') OR (outcome = 'changed' AND from_status <> to_status) GROUP BY ALL")
def fact_history(spark: SparkSession, d: str) -> DataFrame:
    """K-03: what the merge adds to the history, by transition."""
    return runs.history(_merged(spark, d), F.lit("now")).groupBy("outcome", "from_status", "to_status").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def isolated_nodes(spark: SparkSession, d: str) -> DataFrame:
    """S6 of A-05: orders that nothing touches."""
    return table(spark, d, "orders").select("o_orderkey").join(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti")


@query(_MATCHED + " SELECT root, file FROM m GROUP BY root, file HAVING bool_or(category = 'http-entry-point') AND NOT coalesce(bool_or(category = 'security-control'), false)")
def threat_anti_join(spark: SparkSession, d: str) -> DataFrame:
    """F-12: files with an entry point and no control."""
    m = evidence.match_signals(_facts(spark, d))
    key = ["root", "file"]
    return m.where("category = 'http-entry-point'").select(*key).distinct().join(m.where("category = 'security-control'").select(*key), key, "left_anti")


@query(_MATCHED + """, l AS (SELECT DISTINCT root, file FROM source_lines WHERE regexp_matches(text, '(?i)time-?out'))
SELECT root, file, coalesce(bool_or(reference_name ILIKE '%retry%' AND match_source = 'decorator'), false) AS has_retry, coalesce(bool_or(l_hit), false) AS has_timeout FROM (
  SELECT root, file, reference_name, match_source, false AS l_hit FROM m WHERE reference_name ILIKE '%retry%' UNION ALL SELECT root, file, NULL, NULL, true FROM l) GROUP BY root, file""")
def resilience_lens(spark: SparkSession, d: str) -> DataFrame:
    """F-13: files with retry decorators or a configured timeout."""
    retry = _facts(spark, d).where(F.lower("reference_name").contains("retry")).select("root", "file", (F.col("match_source") == "decorator").alias("r"), F.lit(False).alias("t"))
    timeout = table(spark, d, "source_lines").where(F.col("text").rlike("(?i)time-?out")).select("root", "file", F.lit(False).alias("r"), F.lit(True).alias("t"))
    return retry.unionByName(timeout).groupBy("root", "file").agg(F.bool_or("r").alias("has_retry"), F.bool_or("t").alias("has_timeout"))


@query(_UNITS + """, cov AS (SELECT count(*) FILTER (kind = 'service') AS services, count(*) FILTER (kind = 'database') AS stores, count(*) FILTER (kind = 'topic') AS topics, count(*) FILTER (band = 'high') AS high, count(*) AS units FROM u)
SELECT services, stores, topics, high, units, CASE WHEN units > 0 THEN round(high / units, 3) ELSE 1 END AS high_ratio FROM cov""")
def coverage_metrics(spark: SparkSession, d: str) -> DataFrame:
    """A-05, A-08: counts of units by kind and the share with high confidence."""
    n = lambda c: F.count_if(c).cast("bigint")
    k = units(spark, d).agg(n(F.col("kind") == "service").alias("services"), n(F.col("kind") == "database").alias("stores"), n(F.col("kind") == "topic").alias("topics"), n(F.col("band") == "high").alias("high"), F.count("*").alias("units"))
    return k.withColumn("high_ratio", runs.ratio(F.col("high"), F.col("units"), 1.0))


@query("""SELECT DISTINCT root, file, line, regexp_replace(text, '(?i)((?:password|passwd|secret|api[_-]?key|access[_-]?key|private[_-]?key|token|auth)\\s*[:=]\\s*)([''"]?)([^''",\\s]+)([''"]?)', '\\1\\2[REDACTED]\\4', 'g') AS text FROM source_lines""")
def redact_assignments(spark: SparkSession, d: str) -> DataFrame:
    """The snippet rule: values of assignments that look secret, in every line."""
    return table(spark, d, "source_lines").select("root", "file", "line", fn.redact_assignment(F.col("text")).alias("text")).distinct()


@query("""SELECT doc_id, CAST(p AS BIGINT) AS line, l AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM documents WHERE text IS NOT NULL)""")
def line_explode(spark: SparkSession, d: str) -> DataFrame:
    """S-01: texts as numbered lines."""
    lines = table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "text"))
    return lines.select("doc_id", (F.col("p") + 1).cast("bigint").alias("line"), "text")


@query("""WITH l AS (SELECT DISTINCT root, file, line, text FROM source_lines WHERE line IS NOT NULL), h AS (SELECT DISTINCT root, file, line AS at FROM raw_facts)
SELECT h.root, h.file, CAST(h.at AS BIGINT) AS at, count(*) AS n_lines, CAST(min(l.line) AS BIGINT) AS first_line, CAST(max(l.line) AS BIGINT) AS last_line, CAST(sum(length(l.text)) AS BIGINT) AS n_chars FROM h JOIN l ON l.root = h.root AND l.file = h.file AND l.line BETWEEN h.at - 3 AND h.at + 3 GROUP BY ALL""")
def snippet_window(spark: SparkSession, d: str) -> DataFrame:
    """W-06: the size of three lines around every hit. Each hit names the seven lines it wants, so the range join is an equi-join."""
    h = table(spark, d, "raw_facts").select("root", "file", F.col("line").alias("at")).distinct()
    want = h.select("root", "file", "at", F.explode(F.sequence(F.col("at") - 3, F.col("at") + 3)).alias("line"))
    j = want.join(table(spark, d, "source_lines").select("root", "file", "line", "text").distinct(), ["root", "file", "line"])
    return j.groupBy("root", "file", F.col("at").cast("bigint").alias("at")).agg(F.count("*").alias("n_lines"), F.min("line").cast("bigint").alias("first_line"), F.max("line").cast("bigint").alias("last_line"), F.sum(F.length("text")).cast("bigint").alias("n_chars"))


@query("""WITH l AS (SELECT DISTINCT root, file, line, coalesce(text, '') AS text FROM source_lines WHERE line IS NOT NULL), h AS (SELECT DISTINCT root, file, line AS at FROM raw_facts)
SELECT h.root, h.file, CAST(h.at AS BIGINT) AS at, count(l.line) AS n_lines, CAST(min(l.line) AS BIGINT) AS first_line, CAST(max(l.line) AS BIGINT) AS last_line, string_agg(l.text, chr(10) ORDER BY l.line, l.text) AS snippet FROM h LEFT JOIN l ON l.root = h.root AND l.file = h.file AND l.line BETWEEN h.at - 3 AND h.at + 3 GROUP BY ALL""")
def snippet_text(spark: SparkSession, d: str) -> DataFrame:
    """W-06: the text of three lines around every hit, in order; a hit without lines keeps a row. Each hit names the seven lines it wants, so the range join is an equi-join."""
    h = table(spark, d, "raw_facts").select("root", "file", F.col("line").alias("at")).distinct()
    want = h.select("root", "file", "at", F.explode_outer(F.sequence(F.col("at") - 3, F.col("at") + 3)).alias("line"))
    lines = table(spark, d, "source_lines").where("line is not null").select("root", "file", "line", F.coalesce("text", F.lit("")).alias("text"), F.lit(True).alias("there")).distinct()
    row = F.when(F.col("there"), F.struct("line", "text"))
    j = want.join(lines, ["root", "file", "line"], "left").groupBy("root", "file", "at").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    snippet = F.when(F.size("rows") > 0, F.array_join(F.transform("rows", lambda r: r["text"]), "\n"))
    return j.select("root", "file", F.col("at").cast("bigint").alias("at"), F.size("rows").cast("bigint").alias("n_lines"), F.array_min("rows.line").cast("bigint").alias("first_line"), F.array_max("rows.line").cast("bigint").alias("last_line"), snippet.alias("snippet"))


@query("""SELECT DISTINCT argument, upper(regexp_replace(argument, ':[A-Za-z_]\\w*|\\{[^}]*\\}|<[^>]*>', '{PARAM}', 'g')) AS route_key FROM raw_facts WHERE match_source = 'decorator' AND argument IS NOT NULL""")
def route_normalize(spark: SparkSession, d: str) -> DataFrame:
    """J-13: routes in the form in which they are compared."""
    return table(spark, d, "raw_facts").where("match_source = 'decorator' and argument is not null").select("argument", fn.route_key(F.col("argument")).alias("route_key")).distinct()


_VALUE = "regexp_extract(text, '[A-Za-z_.]+\\s*[:=]\\s*[\"'']?([^\\s\"'',]+)', 1)"


@query(f"""WITH v AS (SELECT DISTINCT root, file, line, {_VALUE} AS v FROM source_lines), h AS (SELECT *, CASE WHEN contains(v, '://') AND regexp_extract(v, '://(?:[^@/]*@)?([^:/?#]+)', 1) <> '' THEN regexp_extract(v, '://(?:[^@/]*@)?([^:/?#]+)', 1)
WHEN regexp_matches(v, '^([a-zA-Z0-9.\\-]+):\\d+$') THEN regexp_extract(v, '^([a-zA-Z0-9.\\-]+):\\d+$', 1) END AS host FROM v) SELECT host, count(*) AS n FROM h WHERE host IS NOT NULL GROUP BY host""")
def config_hosts(spark: SparkSession, d: str) -> DataFrame:
    """S-15: hosts named in assigned values, never the values."""
    v = table(spark, d, "source_lines").select("root", "file", "line", F.regexp_extract("text", r"""[A-Za-z_.]+\s*[:=]\s*["']?([^\s"',]+)""", 1).alias("v")).distinct()
    return v.select(fn.value_host(F.col("v")).alias("host")).where("host is not null").groupBy("host").agg(F.count("*").alias("n"))


_ALIAS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in fn.ENGINES.items()) + "}"


@query(f"""WITH s AS (SELECT DISTINCT root, file, line, lower(regexp_extract(text, '(?i)jdbc:([a-z0-9+]+):', 1)) AS scheme FROM source_lines) SELECT scheme, ({_ALIAS})[scheme] AS engine, count(*) AS n FROM s WHERE scheme <> '' GROUP BY ALL""")
def jdbc_engines(spark: SparkSession, d: str) -> DataFrame:
    """F-17, F-18: engines of the jdbc addresses in all lines."""
    s = table(spark, d, "source_lines").select("root", "file", "line", fn.jdbc_scheme(F.regexp_extract("text", r"(?i)(jdbc:[a-z0-9+]+:[^\s\"']*)", 1)).alias("scheme")).distinct().where("scheme is not null")
    return s.groupBy("scheme", fn.known_engine(F.col("scheme")).alias("engine")).agg(F.count("*").alias("n"))


@query("""WITH k AS (SELECT DISTINCT root, file, regexp_extract(text, '^(?:export )?([A-Z][A-Z0-9_]*)=', 1) AS key FROM source_lines WHERE regexp_matches(file, '\\.(env|sh)$')),
s AS (SELECT *, CASE WHEN key LIKE '%_API_ADDR' AND length(key) > 9 THEN key[:-10] WHEN key LIKE '%\\_ADDR' ESCAPE '\\' AND length(key) > 5 THEN key[:-6] WHEN key LIKE '%\\_URI' ESCAPE '\\' AND length(key) > 4 THEN key[:-5] WHEN key LIKE '%\\_URL' ESCAPE '\\' AND length(key) > 4 THEN key[:-5] WHEN key LIKE '%\\_HOST' ESCAPE '\\' AND length(key) > 5 THEN key[:-6] END AS service FROM k WHERE key <> '')
SELECT coalesce(service, '(none)') AS service, count(*) AS n FROM s GROUP BY ALL""")
def env_services(spark: SparkSession, d: str) -> DataFrame:
    """F-10: services that environment keys name."""
    k = table(spark, d, "source_lines").where(F.col("file").rlike(r"\.(env|sh)$")).select("root", "file", F.regexp_extract("text", r"^(?:export )?([A-Z][A-Z0-9_]*)=", 1).alias("key")).distinct().where("key <> ''")
    return k.groupBy(F.coalesce(fn.env_service(F.col("key")), F.lit("(none)")).alias("service")).agg(F.count("*").alias("n"))


@query("""WITH u AS (SELECT root, file, from_node_name AS unit, min(line) AS a, max(line) AS b, min(ord) AS o FROM raw_facts WHERE from_node_kind = 'class' GROUP BY ALL), n AS (SELECT DISTINCT root, file, line, ord FROM raw_facts WHERE match_source = 'call'),
j AS (SELECT n.ord AS node_id, u.unit, row_number() OVER (PARTITION BY n.ord ORDER BY CASE WHEN n.line BETWEEN u.a AND u.b THEN 0 ELSE 1 END, u.o) AS k FROM n JOIN u ON u.root = n.root AND u.file = n.file) SELECT node_id, unit AS unit_id FROM j WHERE k = 1""")
def node_to_unit(spark: SparkSession, d: str) -> DataFrame:
    """J-04: calls to the class of their file whose lines hold them."""
    f = table(spark, d, "raw_facts")
    u = f.where("from_node_kind = 'class'").groupBy("root", "file", F.col("from_node_name").alias("unit_id")).agg(F.min("line").alias("start_line"), F.max("line").alias("end_line"), F.min("ord").alias("unit_ord"))
    return relations.node_to_unit(f.where("match_source = 'call'").select(F.col("ord").alias("node_id"), "root", "file", "line").distinct(), u)


@query("""SELECT DISTINCT CASE WHEN from_node_kind = 'method' THEN coalesce(regexp_extract(from_node_id, '#(.*)$', 1), from_node_name) ELSE from_node_name END AS source, reference_name AS target, match_source AS relation FROM raw_facts WHERE from_node_name IS NOT NULL""")
def member_reparent(spark: SparkSession, d: str) -> DataFrame:
    """S-26: edges of methods as edges of their classes. A member is known by its node's id, which ends in its class."""
    f = table(spark, d, "raw_facts").where("from_node_name is not null")
    member = F.concat_ws("@", "from_node_name", "from_node_id")
    e = f.select(F.when(F.col("from_node_kind") == "method", member).otherwise(F.col("from_node_name")).alias("source"), F.col("reference_name").alias("target"), F.col("match_source").alias("relation")).distinct()
    m = f.where("from_node_kind = 'method'").select(member.alias("member"), F.coalesce(F.regexp_extract("from_node_id", "#(.*)$", 1), "from_node_name").alias("owner")).distinct()
    return relations.reparent_members(e, m).select("source", "target", "relation").distinct()


@query("""WITH RECURSIVE e AS (SELECT lower(trim(decision_id)) AS child, min(nullif(lower(trim(supersedes)), '')) AS parent FROM decisions GROUP BY ALL), o AS (SELECT * FROM e WHERE parent IS NOT NULL AND parent <> child),
w AS (SELECT child AS node, parent AS root, 1 AS depth FROM o UNION ALL SELECT w.node, o.parent, w.depth + 1 FROM w JOIN o ON o.child = w.root WHERE w.depth < 64)
SELECT node, arg_max(root, depth) AS root, CAST(max(depth) AS INTEGER) AS depth FROM w GROUP BY node""")
def recursive_paths(spark: SparkSession, d: str) -> DataFrame:
    """S-16, S-25: the first decision of each chain of superseded ones."""
    low = lambda c: F.lower(F.trim(c))
    return relations.ancestors(table(spark, d, "decisions").select(low("decision_id").alias("child"), F.when(low("supersedes") != "", low("supersedes")).alias("parent")))


@query("""SELECT event_id, k AS key, json_extract_string(props, '$."' || k || '"') AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS k FROM events WHERE json_valid(props))""")
def json_flatten(spark: SparkSession, d: str) -> DataFrame:
    """S-13, S-17: objects as keys and values."""
    return table(spark, d, "events").select("event_id", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))


@query("""WITH p AS (SELECT doc_id, regexp_matches(text, '(?i)changelog') AS predicted, regexp_matches(text, '- (Added|Removed|Fixed|Changed):') AS expected FROM documents WHERE text IS NOT NULL),
c AS (SELECT count(*) FILTER (predicted AND expected) AS tp, count(*) FILTER (predicted AND NOT expected) AS fp, count(*) FILTER (NOT predicted AND expected) AS fn FROM p)
SELECT tp, fp, fn, CASE WHEN tp + fp > 0 THEN round(tp / (tp + fp), 3) ELSE 1 END AS precision, CASE WHEN tp + fn > 0 THEN round(tp / (tp + fn), 3) ELSE 1 END AS recall, CASE WHEN tp + fp + fn > 0 THEN round(2 * tp / (2 * tp + fp + fn), 3) ELSE 1 END AS f1 FROM c""")
def score_precision_recall(spark: SparkSession, d: str) -> DataFrame:
    """A-15: change logs told by their heading against those told by their entries."""
    t = table(spark, d, "documents").where("text is not null")
    return runs.precision_recall(t.select(F.col("text").rlike("(?i)changelog").alias("predicted"), F.col("text").rlike("- (Added|Removed|Fixed|Changed):").alias("expected")))


@query("""SELECT CASE WHEN regexp_matches(rationale, '^[a-z0-9-]+:') THEN regexp_extract(rationale, '^([a-z0-9-]+):', 1) WHEN regexp_matches(rationale, '^Residual R-') THEN 'residual' ELSE 'other' END AS mechanism, action, count(*) AS n FROM (SELECT DISTINCT * FROM decisions) GROUP BY ALL""")
def unresolved_by_mechanism(spark: SparkSession, d: str) -> DataFrame:
    """A-04: details by the prefix that names their mechanism."""
    prefix = F.regexp_extract("rationale", r"^([a-z0-9-]+):", 1)
    m = F.when(prefix != "", prefix).when(F.col("rationale").startswith("Residual R-"), "residual").otherwise("other")
    return table(spark, d, "decisions").distinct().groupBy(m.alias("mechanism"), "action").agg(F.count("*").alias("n"))


@query("""WITH s AS (SELECT *, regexp_extract(r, '^(.*):[0-9]+$', 1) AS file, TRY_CAST(regexp_extract(r, ':([0-9]+)$', 1) AS BIGINT) AS line FROM (SELECT DISTINCT decision_id, unnest(evidence_refs) AS r FROM decisions))
SELECT decision_id, r AS ref, nullif(file, '') AS file, line, EXISTS (SELECT 1 FROM source_files f WHERE f.file = s.file) AS known FROM s""")
def reference_resolution(spark: SparkSession, d: str) -> DataFrame:
    """F-25: evidence references cut at their last colon and looked up among the files."""
    r = table(spark, d, "decisions").select("decision_id", F.explode("evidence_refs").alias("ref")).distinct()
    f, line = F.regexp_extract("ref", r"^(.*):[0-9]+$", 1), F.expr(r"try_cast(regexp_extract(ref, ':([0-9]+)$', 1) as bigint)")
    cut = r.select("decision_id", "ref", F.when(f != "", f).alias("file"), line.alias("line"))
    known = table(spark, d, "source_files").select("file").distinct().withColumn("known", F.lit(True))
    return cut.join(known, "file", "left").select("decision_id", "ref", "file", "line", F.coalesce("known", F.lit(False)).alias("known"))


@query("""SELECT root, file, 'iface-' || (row_number() OVER (PARTITION BY root, file ORDER BY o) - 1) AS interface_id, route FROM (SELECT root, file, reference_name || ' ' || argument AS route, min(ord) AS o FROM raw_facts WHERE match_source = 'decorator' AND argument IS NOT NULL GROUP BY ALL)""")
def interface_numbering(spark: SparkSession, d: str) -> DataFrame:
    """W-03, W-04: the routes of a file, first wins, numbered in order."""
    from pyspark.sql import Window

    r = table(spark, d, "raw_facts").where("match_source = 'decorator' and argument is not null").groupBy("root", "file", F.concat_ws(" ", "reference_name", "argument").alias("route")).agg(F.min("ord").alias("o"))
    n = F.row_number().over(Window.partitionBy("root", "file").orderBy("o")) - 1
    return r.select("root", "file", F.concat(F.lit("iface-"), n).alias("interface_id"), "route")


@query(_NATIVE)
def native_routes(spark: SparkSession, d: str) -> DataFrame:
    """S-02: routes read from the text of all files."""
    return trees.native_routes(table(spark, d, "source_lines"))


def _draft_rules() -> list:
    """What must hold for an override as delivered."""
    return [
        ("unknown override_type", F.col("override_type").isin("node_add", "node_remove", "type_change", "node_rename", "boundary_change", "relationship_add", "relationship_remove")), ("no target_ref", F.trim("target_ref") != ""), ("no decision_record_ref", F.trim("decision_record_ref") != ""),
        ("value needed", F.col("override_type").isin("node_remove", "relationship_remove") | F.col("new_value").isNotNull()), ("value must be a string", ~F.col("override_type").isin("type_change", "node_rename") | F.coalesce(F.col("new_value").startswith('"'), F.lit(True))),
    ]


@query("""SELECT DISTINCT override_id, error FROM (SELECT override_id, unnest([CASE WHEN coalesce(override_type, '') NOT IN ('node_add', 'node_remove', 'type_change', 'node_rename', 'boundary_change', 'relationship_add', 'relationship_remove') THEN 'unknown override_type' END,
CASE WHEN coalesce(trim(target_ref), '') = '' THEN 'no target_ref' END, CASE WHEN coalesce(trim(decision_record_ref), '') = '' THEN 'no decision_record_ref' END, CASE WHEN override_type NOT IN ('node_remove', 'relationship_remove') AND new_value IS NULL THEN 'value needed' END,
CASE WHEN override_type IN ('type_change', 'node_rename') AND NOT starts_with(new_value, '"') THEN 'value must be a string' END]) AS error FROM overrides) WHERE error IS NOT NULL""")
def draft_validation(spark: SparkSession, d: str) -> DataFrame:
    """U-05: what is wrong with each override as delivered."""
    return review.validate_drafts(table(spark, d, "overrides"), _draft_rules())


@query("""WITH p AS (SELECT DISTINCT lower(trim(target_ref)) AS unit_id, action AS trigger, target_type AS class FROM decisions WHERE status = 'active' AND deleted_at IS NULL), f AS (SELECT DISTINCT override_id AS id, lower(trim(target_ref)) AS unit_id, 'overridden' AS trigger,
CASE WHEN override_type LIKE 'relationship%' THEN 'relationship' ELSE 'node' END AS class FROM overrides), j AS (SELECT f.id, coalesce(bool_or(p.trigger = f.trigger AND p.class = f.class), false) AS same, count(p.trigger) AS n FROM f LEFT JOIN p ON p.unit_id = f.unit_id GROUP BY f.id)
SELECT id, CASE WHEN same THEN 'carried_forward' WHEN n > 0 THEN 'reconfirm' ELSE 'open' END AS outcome FROM j""")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """J-30: overrides whose target was decided before."""
    low = F.lower(F.trim("target_ref")).alias("unit_id")
    p = table(spark, d, "decisions").where("status = 'active' and deleted_at is null").select(F.col("decision_id").alias("id"), low, F.col("action").alias("trigger"), F.col("target_type").alias("class"))
    f = table(spark, d, "overrides").select(F.col("override_id").alias("id"), low, F.lit("overridden").alias("trigger"), F.when(F.col("override_type").startswith("relationship"), "relationship").otherwise("node").alias("class")).distinct()
    return review.carry_forward(p, f)


@query("""WITH s AS (SELECT DISTINCT lower(trim(target_ref)) AS id, action AS signal FROM decisions WHERE nullif(trim(target_ref), '') IS NOT NULL), c AS (SELECT id, count(DISTINCT signal) AS score FROM s GROUP BY id) SELECT id, score FROM c ORDER BY score DESC, id LIMIT 100""")
def rank_backlog(spark: SparkSession, d: str) -> DataFrame:
    """A-18, W-08: the hundred targets with the most kinds of decisions; the cap is the report's feature."""
    s = table(spark, d, "decisions").where("trim(target_ref) <> ''").select(F.lower(F.trim("target_ref")).alias("id"), F.col("action").alias("signal"))
    return review.rank_and_cap(review.consequence(s), F.lit(False), 100, [F.desc("score"), "id"])[0]


@query("""SELECT decision_id AS id, round((epoch_us(m.now) - epoch_us(min(c.loaded_at))) / 86400000000, 1) AS age_days FROM (SELECT DISTINCT decision_id, lower(trim(target_ref)) AS t FROM decisions) d LEFT JOIN calm_elements c ON lower(trim(c.element_id)) = d.t CROSS JOIN (SELECT max(loaded_at) AS now FROM calm_elements) m GROUP BY decision_id, m.now""")
def residual_age(spark: SparkSession, d: str) -> DataFrame:
    """J-31: days since the element of each decision was first seen, up to the last element of all."""
    e = table(spark, d, "calm_elements").select(F.lower(F.trim("element_id")).alias("unit_id"), F.col("loaded_at").alias("generated_at"))
    r = table(spark, d, "decisions").select(F.col("decision_id").alias("id"), F.lower(F.trim("target_ref")).alias("unit_id")).distinct()
    now = e.agg(F.max("generated_at").alias("now"))  # one row
    return review.residual_age(r.join(F.broadcast(now), F.lit(True)), e, F.col("now"))


@query("""WITH g AS (SELECT l_returnflag, l_linestatus, count(*) AS need FROM lineitem GROUP BY ALL), f AS (SELECT o_orderstatus AS l_linestatus, 'N' AS l_returnflag, count(*) AS have FROM orders GROUP BY ALL) SELECT g.l_returnflag, g.l_linestatus, g.need, coalesce(f.have, 0) AS have FROM g LEFT JOIN f USING (l_returnflag, l_linestatus) WHERE coalesce(f.have, 0) < g.need""")
def topology_compare(spark: SparkSession, d: str) -> DataFrame:
    """A-16: pairs of which there are fewer orders than lines."""
    return review.missing_topology(table(spark, d, "lineitem").select("l_returnflag", "l_linestatus"), table(spark, d, "orders").select(F.lit("N").alias("l_returnflag"), F.col("o_orderstatus").alias("l_linestatus")), ["l_returnflag", "l_linestatus"])
