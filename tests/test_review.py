"""Review operators on small inputs."""

from datetime import datetime

from pyspark.sql import functions as F

from gristmill.operators import review
from gristmill.sources import trees
from tests.conftest import same_rows


def df(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_lookups(spark):
    m = df(spark, "kind string, to_kind string, shape string", ("a", "b", "x"), (None, None, "connects"))
    same_rows(review.lookup_with_default(df(spark, "kind string, to_kind string", ("a", "b"), ("a", "z"), (None, "b")), m, ["kind", "to_kind"], "shape").collect(), [("a", "b", "x"), ("a", "z", "connects"), (None, "b", "connects")])
    rel = df(spark, "from_id string, to_id string, rule string", ("a", "b", "R"), ("a", "b", None), ("b", "c", None), ("c", "d", None))
    ev = df(spark, "unit_id string, ord int, protocol string", ("b", 2, "late"), ("b", 1, "JDBC"), ("b", 0, None))
    same_rows(review.infer_protocol(rel, ev, F.col("rule")).select("from_id", "to_id", "protocol").collect(), [("a", "b", "R"), ("a", "b", "JDBC"), ("b", "c", "JDBC"), ("c", "d", None)])


def test_imports_and_clients(spark):
    imp = df(spark, "root string, file string, target string, language string", ("r", "a", "pymongo", "python"), ("r", "b", "org.postgresql.Driver", "java"), ("r", "package.json", "pg", "typescript"), ("r", "c", "pymongox", "python"), ("r", "d", "requests", "python"))
    libs = {"python": ["pymongo"], "java": ["org.postgresql"], "typescript": ["pg"]}
    hit = trees.library_imports(imp, libs, F.col("language"))
    same_rows([(r.file,) for r in hit.collect()], [("a",), ("b",)])
    cls = df(spark, "root string, file string, name string, line int, last_line int", ("r", "a", "A", 3, 9), ("r", "b", "B", 1, None), ("r", "c", "C", 1, 2))
    same_rows(review.import_units(hit, cls, df(spark, "root string, file string", ("r", "b")), "database").collect(), [("r", "a", "A", "pymongo", 3, 9, "database", 20)])
    wired = df(spark, "root string, file string, name string", ("r", "a", "A"))
    assert review.import_units(hit, cls, df(spark, "root string, file string", ("r", "b")), "database", wired=wired).count() == 0
    owners = df(spark, "root string, file string, name string, library string", ("r", "b", "B", "org.postgresql"))
    got = review.import_units(hit, cls, df(spark, "root string, file string"), "database", owners=owners, owned=["pymongo", "org.postgresql"])
    assert [r.name for r in got.collect()] == ["B"]
    same_rows(review.outbound_http(imp, F.col("target") == "requests", F.lit(False)).select("file", "reason").collect(), [("d", "CROSS_DOMAIN_UNRESOLVED")])


def test_residuals(spark):
    s = "id string, trigger string, class string, unit_id string"
    prior, fresh = df(spark, s, ("p", "t", "c", "u1"), ("p", "t", "c", "u2")), df(spark, s, ("x", "t", "c", "u1"), ("y", "t", "d", "u2"), ("z", "t", "c", "u9"))
    same_rows(review.carry_forward(prior, fresh).collect(), [("x", "carried_forward"), ("y", "reconfirm"), ("z", "open")])
    packs = df(spark, "unit_id string, generated_at timestamp", ("u1", datetime(2026, 1, 1)), ("u1", datetime(2026, 1, 5)))
    same_rows(review.residual_age(fresh.select("id", "unit_id"), packs, F.lit("2026-01-02 12:00:00").cast("timestamp")).collect(), [("x", 1.5), ("y", None), ("z", None)])
    kept, rest = review.rank_and_cap(df(spark, "id string, k boolean, n int", ("a", True, 0), ("b", False, 1), ("c", False, 2), ("d", False, 3)), F.col("k"), 1, [F.desc("n")])
    assert {r.id for r in kept.collect()} == {"a", "d"} and rest.first().left_out == 2
    top = review.top_options(df(spark, "k string, n int", *[("a", i) for i in range(12)], ("b", 1)), ["k"], ["n"])
    assert top.count() == 11 and {r.k: r.overflow for r in top.collect()} == {"a": 2, "b": 0}


def test_drafts_and_exams(spark):
    d = df(spark, "override_id string, x string", ("a", "ok"), ("b", None), ("b", None))
    same_rows(review.validate_drafts(d, [("no x", F.col("x") == "ok")]).collect(), [("b", "no x")])
    anchors = df(spark, "tier string, class string, answer string, override_type string", ("A", "c", "yes", None), ("B", "c", "p", "type_change"), ("B", "c", "q", "type_change"), ("C", "c", "yes", "node_remove"))
    sib = df(spark, "id int, tier string, class string", (1, "A", "c"), (2, "B", "c"), (3, "C", "c"))
    same_rows(review.bulk_replicate(anchors, sib, ["tier", "class"]).select("id", "answer").collect(), [(1, "yes")])
    assert [r.state for r in review.preview(sib, sib.where("id < 3"), "id").collect()] == ["draft"]
    assert [r.id for r in review.leftovers([sib, sib], sib.where("id > 1"), "id").collect()] == [1]
    pairs = df(spark, "a string, b string", ("x", "y"), ("x", "y"), ("z", "z"))
    same_rows(review.missing_topology(pairs, pairs.limit(1), ["a", "b"]).where("a = 'z' or need - have > 0").collect(), [("x", "y", 2, 1), ("z", "z", 1, 0)])
    g = df(spark, "m boolean, n int", (True, 1), (False, 1), (None, 1)).select(review.exam_guard(F.col("m"), F.col("n")).alias("o"))
    assert [r.o for r in g.collect()] == ["refused", "scored", "not-applicable"]
    fired = df(spark, "engine string, mechanism string", ("e", "m"), ("e", "m"), ("e", "x"))
    same_rows(review.capability_warnings(fired, df(spark, "engine string, mechanism string, state string", ("e", "m", "proven"))).collect(), [("e", "x", 1)])
    assert review.review_worthy(df(spark, "reason string", ("TEST_CODE",), ("AMBIGUOUS_BOUNDARY",))).count() == 1


def test_import_units_broadcast_nothing(spark):
    lines = lambda *xs: spark.range(3).selectExpr("'r' as root", "concat('f', id) as file", "id", f"explode(array({', '.join(xs)})) as library").select("root", "file", F.concat(F.lit("P"), "id").alias("name"), "library")
    imports, every = lines("'a'", "'b'"), lines("'a'")
    classes = every.select("root", "file", "name", F.lit(5).alias("line"), F.lit(8).alias("last_line"))
    got = review.import_units(imports, classes, every.where("name = 'P0'"), "database", every.where("name = 'P1'"), every, ["a"])
    assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()
    same_rows(got.collect(), [("r", "f2", "P2", "a", 5, 8, "database", 20)])
