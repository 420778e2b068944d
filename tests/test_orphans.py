"""Orphans: direct ones by lifetimes, inherited ones by the cascade."""

from datetime import datetime

from gristmill.operators import orphans
from tests.conftest import same_rows

O = "override_id string, override_type string, decision_record_ref string, target_ref string, loaded_at timestamp, id string"  # noqa: E741
D = "decision_id string, supersedes string, loaded_at timestamp, deleted_at timestamp, space string"
E = "element_id string, loaded_at timestamp, deleted_at timestamp"


def day(n):
    return datetime(2026, 1, n)


def run(spark, o, d, e):
    od, dd, ed = spark.createDataFrame(o, O), spark.createDataFrame(d, D), spark.createDataFrame(e, E)
    return orphans.orphan_cascade(orphans.review_references(od, dd), orphans.review_lifetimes(dd, ed))


def test_lifetimes_cascade_and_dirt(spark):
    d = [
        ("D-1", None, day(1), None, "x"), ("D-1", None, day(1), None, "x"), ("D-2", " d-9", day(2), None, "x"), ("D-3", "D-2 ", day(3), None, "x"), ("D-4", "d-3", day(4), None, "x"),
        ("D-5", "D-1", day(5), day(6), "x"), ("D-6", "D-7", day(6), None, "x"), ("D-7", "D-6", day(6), None, "x"), ("D-8", "  ", day(6), None, "x"),
    ]
    o = [
        ("O-1", "node_rename", "D-4", "el-1", day(10), "c"), ("O-2", "node_add", "D-1", "nowhere", day(10), "c"), ("O-3", "node_rename", "d-5 ", " EL-1", day(10), "c"),
        ("O-4", "node_rename", "D-1", "el-1", day(1), "c"), ("O-5", None, None, "", day(10), "c"), ("O-6", "node_remove", "D-1", "el-2", day(10), "c"), ("O-4", "node_rename", "D-1", "el-1", day(10), "c"),
    ]
    e = [("el-1", day(2), None), ("el-2", day(2), day(9)), ("el-2", day(12), None)]
    got = {(r.ref_table, r.ref_field, r.ref_key, r.orphan_kind, r.depth) for r in run(spark, o, d, e).collect()}
    assert got == {
        ("decisions", "supersedes", "D-2", "direct", 0), ("decisions", "supersedes", "D-3", "inherited", 1), ("decisions", "supersedes", "D-4", "inherited", 2),
        ("overrides", "decision_record_ref", "O-1", "inherited", 3), ("overrides", "decision_record_ref", "O-3", "direct", 0), ("overrides", "target_ref", "O-4", "direct", 0), ("overrides", "target_ref", "O-6", "direct", 0),
    }


def test_a_chain_of_two_thousand(spark):
    d = [(f"D-{i}", f"D-{i - 1}", day(1 + i % 2), None, "x") for i in range(2000)]
    d = [(i, s, day(2), None, x) for i, s, _, _, x in d] + [("C-1", "C-2", day(2), None, "x"), ("C-2", "C-1", day(2), None, "x"), ("C-3", "D-1999", day(2), None, "x"), ("C-3", "D-5", day(2), None, "x")]
    got = {(r.ref_key, r.depth) for r in run(spark, [], d, []).collect()}
    assert got == {(f"D-{i}", i) for i in range(2000)} | {("C-3", 6)}


def test_direct_orphans_are_those_of_the_cascade(spark, sf):
    from gristmill.plans import problems

    refs, lives = problems._orphans(spark, sf)
    whole = orphans.orphan_cascade(refs, lives)
    same_rows(orphans.direct_orphans(refs, lives).collect(), whole.where("depth = 0").collect())


def test_empty_tables(spark):
    assert run(spark, [], [], []).count() == 0


def test_null_arrival_has_no_live_record(spark):
    got = run(spark, [("O-1", "x", "D-1", None, None, "c")], [("D-1", None, day(1), None, "x")], []).collect()
    same_rows(got, [("overrides", "decision_record_ref", None, "O-1", "direct", 0)])


def test_cascade_has_no_cap():
    import inspect

    assert list(inspect.signature(orphans.orphan_cascade).parameters) == ["references", "lifetimes"]


def test_found_comes_from_the_whole_cascade(spark, tmp_path, monkeypatch):
    from gristmill.plans import problems

    d = [("D-1", "gone", day(1), None, "x"), ("D-2", "D-1", day(2), None, "x"), ("D-3", "D-2", day(3), None, "x"), ("D-3", "gone", day(3), None, "x")]
    for name, rows, schema in (("overrides", [("O-1", "node_rename", "D-3", "el-1", day(9), "c")], O), ("decisions", d, D), ("calm_elements", [("el-1", day(1), None)], E)):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    ran, cascade = [], orphans.orphan_cascade
    monkeypatch.setattr(orphans, "orphan_cascade", lambda *a: ran.append(cascade(*a)) or ran[0])
    got = problems.p1_found(spark, str(tmp_path))
    assert len(ran) == 1
    same_rows(got.collect(), [("decisions", "supersedes", "2026-01", "D-1"), ("decisions", "supersedes", "2026-01", "D-3")])
    assert {(r.ref_key, r.depth) for r in ran[0].collect()} == {("D-1", 0), ("D-2", 1), ("D-3", 0), ("O-1", 1)}
