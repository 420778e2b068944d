"""Views that give the domain operators their inputs from the tables at hand, each with the SQL of the same view. Nothing here computes results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.session import table

#: A nation is a run: its customers are services, its suppliers stores and topics; in every fifth nation there are no services. Orders are the edges.
RUNS_SQL = """n AS (SELECT n_nationkey AS run, CASE WHEN n_nationkey % 7 = 0 THEN 'failed' WHEN n_nationkey % 7 = 1 THEN 'skipped' ELSE 'ok' END AS cross_package_status,
  CAST(CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey % 4 END AS BIGINT) AS cfn_found, CAST(n_nationkey % 2 AS BIGINT) AS cfn_bound FROM nation),
un AS (SELECT c_nationkey AS run, 'c' || c_custkey AS unit_id, 'src/c' || c_custkey || '.java' AS file, 'service' AS kind, CAST(c_custkey % 100 AS BIGINT) AS confidence, c_custkey % 3 <> 0 AS has_http, c_mktsegment = 'BUILDING' AS has_control, false AS has_messaging FROM customer WHERE c_nationkey % 5 <> 0
  UNION ALL SELECT s_nationkey, 's' || s_suppkey, 'src/s' || s_suppkey || '.java', CASE WHEN s_suppkey % 3 = 0 THEN 'topic' ELSE 'database' END, CAST(s_suppkey % 100 AS BIGINT), false, false, s_acctbal > 0 FROM supplier),
re AS (SELECT s_nationkey AS run, 'c' || o_custkey AS from_id, 's' || l_suppkey AS to_id, min(l_orderkey) AS o FROM orders JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN customer ON c_custkey = o_custkey WHERE c_nationkey = s_nationkey AND s_nationkey % 4 <> 2 GROUP BY ALL),
rel AS (SELECT run, 'r-' || from_id || '-' || to_id AS id, from_id, to_id, CASE WHEN o % 2 = 0 THEN 'architecture' ELSE 'structural' END AS grade, CAST(CASE WHEN o % 5 = 0 THEN NULL ELSE o % 80 END AS BIGINT) AS confidence FROM re)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    """(run, cross_package_status, cfn_found, cfn_bound)."""
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(
        k.alias("run"), F.when(k % 7 == 0, "failed").when(k % 7 == 1, "skipped").otherwise("ok").alias("cross_package_status"), F.when(k % 3 != 0, k % 4).cast("bigint").alias("cfn_found"), (k % 2).cast("bigint").alias("cfn_bound")
    )


def run_units(spark: SparkSession, d: str) -> DataFrame:
    """(run, unit_id, file, kind, confidence, has_http, has_control, has_messaging)."""
    c, s = table(spark, d, "customer").where("c_nationkey % 5 <> 0"), table(spark, d, "supplier")
    row = lambda df, run, key, letter, kind, http, control, messaging: df.select(
        F.col(run).alias("run"), F.concat(F.lit(letter), key).alias("unit_id"), F.concat(F.lit(f"src/{letter}"), key, F.lit(".java")).alias("file"), kind.alias("kind"), (F.col(key) % 100).cast("bigint").alias("confidence"),
        http.alias("has_http"), control.alias("has_control"), messaging.alias("has_messaging"),
    )
    no = F.lit(False)
    a = row(c, "c_nationkey", "c_custkey", "c", F.lit("service"), F.col("c_custkey") % 3 != 0, F.col("c_mktsegment") == "BUILDING", no)
    return a.unionByName(row(s, "s_nationkey", "s_suppkey", "s", F.when(F.col("s_suppkey") % 3 == 0, "topic").otherwise("database"), no, no, F.col("s_acctbal") > 0))


def run_relationships(spark: SparkSession, d: str) -> DataFrame:
    """(run, id, from_id, to_id, grade, confidence)."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(o, "l_orderkey")
    c, s = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), table(spark, d, "supplier").where("s_nationkey % 4 <> 2").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    e = li.join(s, "l_suppkey").join(c, "o_custkey").where("c_nationkey = s_nationkey").groupBy(F.col("s_nationkey").alias("run"), F.concat(F.lit("c"), "o_custkey").alias("from_id"), F.concat(F.lit("s"), "l_suppkey").alias("to_id")).agg(F.min("l_orderkey").alias("o"))
    return e.select("run", F.concat_ws("-", F.lit("r"), "from_id", "to_id").alias("id"), "from_id", "to_id", F.when(F.col("o") % 2 == 0, "architecture").otherwise("structural").alias("grade"), F.when(F.col("o") % 5 != 0, F.col("o") % 80).cast("bigint").alias("confidence"))


#: Rejected rows of the runs, from orders of their customers: each kind of detail that the queue knows.
IGNORED_SQL = """ig AS (SELECT c_nationkey AS run, CASE o_orderkey % 9 WHEN 4 THEN 's' || (o_orderkey % 40) ELSE 'src/c' || c_custkey || '.java:' || (o_orderkey % 50) END AS ref,
  CASE o_orderkey % 9 WHEN 4 THEN 'AMBIGUOUS_BOUNDARY' WHEN 5 THEN 'INSUFFICIENT_EVIDENCE' WHEN 6 THEN 'TEST_CODE' ELSE 'CROSS_DOMAIN_UNRESOLVED' END AS reason,
  CASE o_orderkey % 9 WHEN 0 THEN 'unresolved-multi-hop: "c' || c_custkey || '" to bridge ' || o_orderkey WHEN 1 THEN 'tier-b-single-candidate: "c' || c_custkey || '" may be s' || (o_orderkey % 40) WHEN 2 THEN 'unresolved-http-target: ' || o_orderkey
    WHEN 3 THEN 'unresolved-env-target: "dep-' || (o_orderkey % 30) || '" of ' || o_orderkey WHEN 4 THEN 'contradiction: engine ' || o_orderkey WHEN 5 THEN 'hand-rolled-resilience-candidate: calls ' || o_orderkey
    WHEN 7 THEN 'unresolved-cfn-route: ' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') ELSE 'other ' || o_orderkey END AS detail FROM orders JOIN customer ON c_custkey = o_custkey),
dep AS (SELECT DISTINCT s_nationkey AS run, 'dep-' || (s_suppkey % 30) AS name, min('s' || s_suppkey) AS unit_id FROM supplier GROUP BY ALL)"""


def run_ignored(spark: SparkSession, d: str) -> DataFrame:
    """(run, ref, reason, detail)."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey")).join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    k, n = F.col("o_orderkey"), F.col("o_orderkey") % 9
    s40 = F.concat(F.lit("s"), k % 40)
    detail = (
        F.when(n == 0, F.concat(F.lit('unresolved-multi-hop: "c'), "c_custkey", F.lit('" to bridge '), k)).when(n == 1, F.concat(F.lit('tier-b-single-candidate: "c'), "c_custkey", F.lit('" may be '), s40)).when(n == 2, F.concat(F.lit("unresolved-http-target: "), k))
        .when(n == 3, F.concat(F.lit('unresolved-env-target: "dep-'), k % 30, F.lit('" of '), k)).when(n == 4, F.concat(F.lit("contradiction: engine "), k)).when(n == 5, F.concat(F.lit("hand-rolled-resilience-candidate: calls "), k))
        .when(n == 7, F.concat(F.lit("unresolved-cfn-route: "), F.lpad(k.cast("string"), 9, "0"))).otherwise(F.concat(F.lit("other "), k))
    )
    reason = F.when(n == 4, "AMBIGUOUS_BOUNDARY").when(n == 5, "INSUFFICIENT_EVIDENCE").when(n == 6, "TEST_CODE").otherwise("CROSS_DOMAIN_UNRESOLVED")
    ref = F.when(n == 4, s40).otherwise(F.concat(F.lit("src/c"), "c_custkey", F.lit(".java:"), k % 50))
    return o.select(F.col("c_nationkey").alias("run"), ref.alias("ref"), reason.alias("reason"), detail.alias("detail"))


def run_deployments(spark: SparkSession, d: str) -> DataFrame:
    """(run, name, unit_id)."""
    return table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("run"), F.concat(F.lit("dep-"), F.col("s_suppkey") % 30).alias("name")).agg(F.min(F.concat(F.lit("s"), "s_suppkey")).alias("unit_id"))


def json_files(df: DataFrame) -> DataFrame:
    """(root, file, text) of ``df`` (root, file, doc), doc a struct that becomes JSON text."""
    return df.select("root", "file", F.to_json("doc").alias("text"))


# Images of the synthetic deployments, by supplier key.
IMAGES = ["library/postgres:15", "registry.invalid/app:1", "redis", "registry.invalid:5000/team/mongo:6", "registry.invalid/worker"]
IMAGES_SQL = "[" + ", ".join(f"'{x}'" for x in IMAGES) + "]"
#: Deployments: one for each supplier, named by it, in the namespace of its nation, with a configuration shared by its nation and a secret shared by a few.
DEPLOY_SQL = f"""dp AS (SELECT 'svc-' || s_suppkey AS name, lower(n_name) AS namespace, {IMAGES_SQL}[s_suppkey % 5 + 1] AS image, 'box' AS container_name, 'cm-' || s_nationkey AS config_map, 'sec-' || (s_suppkey % 45) AS secret, CASE WHEN s_suppkey % 4 = 0 THEN 'private.pem' WHEN s_suppkey % 4 = 1 THEN NULL ELSE 'public.pem' END AS item
  FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""


def deployment_files(spark: SparkSession, d: str) -> DataFrame:
    """(root, file, text): manifests of deployments and of configuration maps, as JSON."""
    n = table(spark, d, "nation").select("n_nationkey", F.lower("n_name").alias("ns"))
    s = table(spark, d, "supplier").join(F.broadcast(n), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    st = lambda **kw: F.struct(*(v.alias(x) for x, v in kw.items()))
    item = F.when(k % 4 == 0, "private.pem").when(k % 4 != 1, "public.pem")
    items = F.when(item.isNotNull(), F.array(st(key=item)))
    image = F.element_at(F.array(*(F.lit(x) for x in IMAGES)), (k % 5 + 1).cast("int"))
    container = st(name=F.lit("box"), image=image, envFrom=F.array(st(configMapRef=st(name=F.concat(F.lit("cm-"), "s_nationkey")))))
    pod = st(containers=F.array(container), volumes=F.array(st(secret=st(secretName=F.concat(F.lit("sec-"), k % 45), items=items))))
    doc = st(kind=F.lit("Deployment"), metadata=st(name=F.concat(F.lit("svc-"), k), namespace=F.col("ns")), spec=st(template=st(spec=pod)))
    a = s.select(F.lit("k8s").alias("root"), F.concat(F.lit("deploy/"), k, F.lit(".json")).alias("file"), doc.alias("doc"))
    maps = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(F.concat(F.lit("SVC"), "s_suppkey", F.element_at(F.array(F.lit("_ADDR"), F.lit("_API_ADDR"), F.lit("_URL"), F.lit("_PORT")), (k % 4 + 1).cast("int"))).alias("k"), F.concat(F.lit("http://u:p@svc-"), k % 7, F.lit(":80/x")).alias("v"))))).alias("data"))
    b = maps.select(F.lit("k8s").alias("root"), F.concat(F.lit("config/"), "s_nationkey", F.lit(".json")).alias("file"), st(kind=F.lit("ConfigMap"), metadata=st(name=F.concat(F.lit("cm-"), "s_nationkey")), data=F.col("data")).alias("doc"))
    return json_files(a).unionByName(json_files(b))


CONFIG_SQL = "ck AS (SELECT 'cm-' || s_nationkey AS config_map, 'SVC' || s_suppkey || ['_ADDR', '_API_ADDR', '_URL', '_PORT'][s_suppkey % 4 + 1] AS key, 'svc-' || (s_suppkey % 7) AS host FROM supplier)"
