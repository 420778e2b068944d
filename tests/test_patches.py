"""Patches: composition is associative, and the feed gives what a plain loop gives, in any partitioning."""

import json
import random
from datetime import datetime, timedelta, timezone

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gristmill.operators import patches
from tests.conftest import same_rows

SCHEMA = "override_id string, target_ref string, override_type string, new_value string, status string, created_at string, loaded_at timestamp, k string"


def fold(rows):
    """The feed by the letter: latest delivery, active only, in order of instant and id."""
    last = {}
    for r in rows:
        key = (r[0] or "").strip().lower()
        if key and (key not in last or r[6] > last[key][6]):
            last[key] = r
    live = {}
    for key, r in sorted(((k, r) for k, r in last.items() if r[4] == "active"), key=lambda x: (datetime.fromisoformat(x[1][5]), x[0])):
        t = (r[1] or "").strip().lower()
        v = json.loads(r[3]) if r[3] else None
        if not t:
            continue
        if r[2] == "node_add":
            live.setdefault(t, [v["node-type"], v["name"], ""])
        elif r[2] == "node_remove":
            live.pop(t, None)
        elif t in live and r[2] == "boundary_change":
            live[t][2] = (v or {}).get("container") or ""
        elif t in live and isinstance(v, str):
            live[t][0 if r[2] == "type_change" else 1] = v
    return [(t, *s) for t, s in live.items()]


def feed(n, seed, targets):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        op = rng.choice(["node_add", "node_add", "node_remove", "type_change", "node_rename", "boundary_change", "relationship_add"])
        value = {"node_add": json.dumps({"node-type": f"t{i}", "name": f"né {i}"}), "type_change": rng.choice([f'"u{i}"', '{"to": "x"}', None]), "node_rename": f'"w\\u00e9 {i}"', "boundary_change": rng.choice(['{"container": null}', f'{{"container": "c{i}"}}'])}.get(op)
        at = datetime(2026, 1, 1, tzinfo=timezone(timedelta(hours=rng.choice([0, 5, -8])))) + timedelta(minutes=rng.randrange(n))
        row = (f"{rng.choice(['', ' '])}O-{i:05d}", rng.choice(["", " "]) + rng.choice(targets).upper(), op, value, rng.choice(["active"] * 5 + ["retired"]), at.isoformat(), datetime(2026, 2, 1) + timedelta(seconds=i), "clash")
        rows.append(row)
        if rng.random() < 0.2:
            rows.append((row[0].lower(), *row[1:4], rng.choice(["active", "retired"]), row[5], row[6] + timedelta(days=1), "clash"))
    return rows + rows[:5]


def test_feed_like_a_loop_with_a_hot_key(spark):
    rows = feed(900, 3, ["hot"] * 6 + ["a", "b", "c"]) + [(None, "a", "node_add", '{"node-type": "x", "name": "y"}', "active", "2026-01-01T00:00:00Z", datetime(2026, 1, 1), "c"), ("O-x", " ", "node_remove", None, "active", "2026-01-01T00:00:00Z", datetime(2026, 1, 1), "c")]
    for parts in (1, 7):
        df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
        same_rows(patches.rebuild_nodes(df).collect(), fold(rows))


def test_base_and_empty_feed(spark):
    base = spark.createDataFrame([("A", "t", None, "c"), ("b", "t", "n", "")], "target_ref string, node_type string, node_name string, container string")
    empty = spark.createDataFrame([], SCHEMA)
    same_rows(patches.rebuild_nodes(empty, base).collect(), [("a", "t", "", "c"), ("b", "t", "n", "")])
    assert patches.rebuild_nodes(empty).count() == 0
    rows = [("O-1", "a", "node_rename", '"new"', "active", "2026-01-01 00:00:00+0100", datetime(2026, 1, 1), "c"), ("O-2", "b", "node_remove", None, "active", "2026-01-01T00:00:00Z", datetime(2026, 1, 1), "c")]
    same_rows(patches.rebuild_nodes(spark.createDataFrame(rows, SCHEMA), base).collect(), [("a", "t", "new", "c")])


def test_instants(spark):
    texts = ["2026-01-01T05:00:00+05:00", "2026-01-01T00:00:00Z", "2026-01-01 00:00:00.000z", " 2025-12-31T16:00:00-0800 ", "nonsense", None]
    got = spark.createDataFrame([(t,) for t in texts], "x string").select(patches.parse_instant("x").alias("t")).collect()
    assert [r.t for r in got] == [datetime(2026, 1, 1)] * 4 + [None] * 2


OPS = st.tuples(st.sampled_from(["node_add", "node_remove", "type_change", "node_rename", "boundary_change"]), st.sampled_from("xyz"))


@settings(max_examples=15, deadline=None)
@given(st.lists(OPS, min_size=3, max_size=9), st.data())
def test_composition_is_associative(spark, ops, data):
    """Cutting the operations anywhere and composing the parts gives the patch of the whole."""
    import pyarrow as pa

    def patch(part):
        if not part:
            return None
        cols = {"k": ["k"] * len(part), "op": [o for o, _ in part], "node_type": [v for _, v in part], "node_name": [v for _, v in part], "container": [v for _, v in part], "part": pa.array([0] * len(part), pa.int32())}
        return list(patches._compose_chunk(iter([pa.RecordBatch.from_pydict(cols)])))[0].to_pylist()[0]

    i = data.draw(st.integers(1, len(ops) - 1))
    f, g, whole = patch(ops[:i]), patch(ops[i:]), patch(ops)
    pick = lambda p: tuple(p[x] for x in patches.FIELDS)
    df = spark.createDataFrame([(pick(f), pick(g))], f"f struct<{patches.PATCH.replace(' boolean', ':boolean').replace(' string', ':string')}>, g struct<{patches.PATCH.replace(' boolean', ':boolean').replace(' string', ':string')}>")
    assert tuple(df.select(patches.compose(F.col("f"), F.col("g")).alias("p")).first().p) == pick(whole)
