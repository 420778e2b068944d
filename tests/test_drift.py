"""Schema drift: scripts, field changes and the unified table."""

import json
from datetime import datetime, timedelta

from gristmill.operators import drift
from gristmill.operators.drift import Node, edit_script, shown
from tests.conftest import same_rows

S = "root string, file_name string, generated_at timestamp, line_no int, payload string, rid string"
T0 = datetime(2026, 1, 1)


def files(spark, *contents, root="r"):
    rows = []
    for i, records in enumerate(contents):
        rows += [(root, f"f{9 - i}", T0 + timedelta(i), j, x if isinstance(x, str) else json.dumps(x), "clash") for j, x in enumerate(records)]
    return spark.createDataFrame(rows + rows[:1], S)


def test_changes_of_every_kind(spark):
    a = [{"evidenceId": 1, "x": "a", "w": 1, "n": None, "gone": 5}, {"evidenceId": 2, "x": "b", "w": 2, "gone": 6}]
    b = [{"evidenceId": 1, "X": "a", "w": 1.5, "n": True, "came": 7}, {"evidenceId": 2, "X": "b", "w": {"value": 2}, "came": 6}, {"evidenceId": 3, "X": "new"}, '{"evidenceId": 4, "broken']
    c = [{"evidenceId": 1, "Y": "a", "w": {"value": 1.5, "unit": "s"}, "n": None, "came": 7}]
    got = drift.field_changes(drift.schema_scripts(files(spark, a, b, c))).collect()
    want = [("f8", "X", "renamed"), ("f8", "gone", "removed"), ("f8", "came", "added"), ("f8", "w", "retyped"), ("f7", "Y", "renamed"), ("f7", "w", "retyped")]
    same_rows(got, want)
    nested = drift.schema_scripts(files(spark, [{"evidenceId": 1, "w": {"value": 1}}], [{"evidenceId": 1, "w": {"value": 1, "unit.x": "s"}}])).select("op", "path", "depth").collect()
    same_rows(nested, [("add", "w.unit.x", 1)])


def held(df):
    """The rows of the one table, without what is null."""
    rows = [r.asDict() for r in df.collect()]
    return [(r["file_name"], r["line_no"], r["evidence_id"], {k: v for k, v in r.items() if k not in ("root", "file_name", "line_no", "evidence_id", "others") and v is not None} | dict(r["others"])) for r in rows]


def test_unified_names_follow_chains_of_renames(spark):
    a, b, c = [{"evidenceId": 1, "x": "a"}], [{"evidenceId": 1, "X": "a"}], [{"evidenceId": 1, "Y": "a", "z": 1}]
    df = drift.unified_table(files(spark, a, b, c))
    assert sorted(held(df), key=str) == [("f7", 0, "1", {"Y": "a", "z": 1.0}), ("f8", 0, "1", {"Y": "a"}), ("f9", 0, "1", {"Y": "a"})]
    assert dict(df.dtypes)["z"] == "double" and dict(df.dtypes)["Y"] == "string"


def ops(spark, *contents):
    return {tuple(r) for r in drift.schema_scripts(files(spark, *contents)).select("op", "path", "to_path", "old_type", "new_type").collect()}


def test_a_field_that_leaves_an_object_is_moved(spark):
    a, b = [{"evidenceId": 1, "w": {"x": 7, "k": 1}}, {"evidenceId": 2, "w": {"x": 8, "k": 1}}], [{"evidenceId": 1, "w": {"k": 1}, "x": 7}, {"evidenceId": 2, "w": {"k": 1}, "x": 8}]
    assert ops(spark, a, b) == {("move", "w.x", "x", "number", "number")}
    assert ops(spark, b, a) == {("move", "x", "w.x", "number", "number")}
    same_rows(drift.field_changes(drift.schema_scripts(files(spark, a, b))).collect(), [("f8", "x", "added")])
    same_rows(drift.field_changes(drift.schema_scripts(files(spark, b, a))).collect(), [("f8", "x", "removed")])
    got = sorted(held(drift.unified_table(files(spark, a, b))), key=str)
    assert [r[3]["x"] for r in got] == [7.0, 8.0, 7.0, 8.0]


def test_arrays_of_objects_are_compared(spark):
    a, b = [{"evidenceId": 1, "items": [{"a": 1, "b": "x"}]}], [{"evidenceId": 1, "items": [{"a": "text", "c": 2}]}]
    assert ops(spark, a, b) == {("retype", "items[].a", "items[].a", "number", "string"), ("delete", "items[].b", None, "string", None), ("add", "items[].c", "items[].c", None, "number")}
    c = [{"evidenceId": 1, "items": [{"z": 1, "b": "x"}, 5, [{"deep": 1}]]}]
    assert ops(spark, a, c) == {("rename", "items[].a", "items[].z", "number", "number"), ("retype", "items[]", "items[]", "object", "array|number|object"), ("add", "items[][]", "items[][]", None, "object")}


def test_values_tell_renames_inside_objects(spark):
    a, b = [{"evidenceId": 1, "w": {"old": "v", "k": 1}}], [{"evidenceId": 1, "w": {"new": "v", "k": 1}}]
    assert ops(spark, a, b) == {("rename", "w.old", "w.new", "string", "string")}
    assert ops(spark, a, [{"evidenceId": 1, "w": {"new": "other", "k": 1}}]) == {("delete", "w.old", None, "string", None), ("add", "w.new", "w.new", None, "string")}
    whole = [{"evidenceId": 1, "W": {"old": "v", "k": 1}}]
    assert ops(spark, a, whole) == {("rename", "w", "W", "object", "object")}
    carried = {tuple(r) for r in drift.schema_scripts(files(spark, a, whole), carried=True).select("op", "path", "to_path").collect()}
    assert carried == {("rename", "w", "W"), ("carry", "w.old", "W.old"), ("carry", "w.k", "W.k")}


def test_no_value_is_lost_where_fields_end_in_one_name(spark):
    contents = [{"evidenceId": 1, "a": 1, "c": 2}], [{"evidenceId": 1, "b": 1, "c": 2}], [{"evidenceId": 1, "c": 2}], [{"evidenceId": 1, "b": 2}]
    got = sorted(held(drift.unified_table(files(spark, *contents))), key=str)
    values = [sorted(r[3].values()) for r in got]
    assert values == [[2.0], [2.0], [1.0, 2.0], [1.0, 2.0]]  # of the last, third, second and first file
    b = {r[0]: r[3].get("b") for r in got}
    assert b["f6"] == 2.0 and b["f7"] == 2.0


def test_few_columns_lose_nothing(spark):
    df = drift.unified_table(files(spark, [{"evidenceId": 1, **{f"k{i}": i for i in range(30)}, "Root": True, "root": "x", "f": [1, {"a": None}]}]), max_columns=5)
    assert len(df.columns) == 4 + 5 + 1
    (row,) = held(df)
    assert len(row[3]) == 33 and {str(v) for v in row[3].values()} >= {"x", "True"} and {float(v) for k, v in row[3].items() if k.startswith("k")} == set(range(30))
    many = drift.unified_table(files(spark, [{"evidenceId": 1, "Root": True, "root": "x", "others": 3}]))
    assert dict(many.dtypes)["Root~2"] == "boolean" and dict(many.dtypes)["root~3"] == "string" and dict(many.dtypes)["others~2"] == "double"


def test_wide_schemas_take_no_long_time():
    import time

    t = time.time()
    old = {(f"a{i}",): Node(frozenset({"string"}), (3, f"s{i}")) for i in range(20_000)}
    new = {(f"b{i}",): Node(frozenset({"string"}), (3, f"s{i}")) for i in range(20_000)} | {("w", f"c{i}"): Node(frozenset({"string"}), (3, "same")) for i in range(20_000)}
    cost, script = edit_script(old, new)
    assert time.time() - t < 20 and sum(s[0] == "rename" for s in script) == 20_000 and cost == 20_000 * (6 + 10)


def test_the_script_is_as_cheap_as_any(spark):
    """Against all assignments of removed to added fields, on small random schemas."""
    import itertools
    import random

    rng = random.Random(5)
    for _ in range(150):
        pool = [("a",), ("b",), ("c",), ("w", "x"), ("w", "y"), ("w", "z")]
        side = lambda: {p: Node(frozenset({"string"}), (1, rng.choice("pq"))) for p in rng.sample(pool, rng.randrange(1, 5))} | {("w",): Node(frozenset({"object"}))}  # noqa: E731, B023
        old, new = side(), side()
        gone, come = [p for p in old if p not in new], [p for p in new if p not in old]
        best = min(
            sum((6 if a[:-1] == b[:-1] else 8) - 20 for a, b in zip(some, perm, strict=True))
            for k in range(min(len(gone), len(come)) + 1) for some in itertools.combinations(gone, k) for perm in itertools.permutations(come, k)
            if all(old[a].evidence == new[b].evidence for a, b in zip(some, perm, strict=True))
        )
        assert edit_script(old, new)[0] == best + 10 * (len(gone) + len(come))


def test_file_without_records_and_empty_table(spark):
    got = drift.field_changes(drift.schema_scripts(files(spark, [{"evidenceId": 1, "a.b": 1}], ["{broken"], [{"evidenceId": 1, "a.b": 1}]))).collect()
    same_rows(got, [("f8", "a.b", "removed"), ("f7", "a.b", "added")])
    empty = spark.createDataFrame([], S)
    assert drift.schema_scripts(empty).count() == 0
    assert drift.unified_table(empty).count() == 0


def test_edit_prefers_the_cheapest_assignment():
    node = lambda sig: Node(frozenset({"string"}), (3, sig))
    cost, script = edit_script({("a",): node("s1"), ("b",): node("s2")}, {("c",): node("s2"), ("d",): node("s9")})
    assert {s[:3] for s in script} == {("rename", ("b",), ("c",)), ("delete", ("a",), None), ("add", ("d",), ("d",))} and cost == 26
    assert shown(("a, b", 0, "x.y")) == "a, b[].x.y"


def test_records_that_do_not_parse(spark):
    for text in ('{"a": 1', "[1]", "3", "null", '{"a": 1, "a": 2}', '{"a": NaN}', "", " ", "[" * 100_000):
        assert drift.record_of(text) is None
    got = drift.schema_scripts(files(spark, [{"evidenceId": 1, "a": 1}], ['{"evidenceId": 1, "a": 1, "a": 2}', '{"evidenceId": 1, "b": \ud83d', '{"evidenceId": 2, "c": ' + "[" * 20_000 + "1" + "]" * 20_000 + "}"], [{"evidenceId": None, "a": 1}, {}]))
    assert {(r.file_name, r.op, r.path) for r in got.collect()} == {("f8", "delete", "a"), ("f7", "add", "a")}


def test_unified_keeps_bare_records(spark):
    got = held(drift.unified_table(files(spark, [{"evidenceId": 1, "a": "x", "b": "y"}, {"evidenceId": 2}, {}])))
    same_rows([(r[1], r[2], tuple(sorted(r[3].items()))) for r in got], [(0, "1", (("a", "x"), ("b", "y"))), (1, "2", ()), (2, None, ())])
