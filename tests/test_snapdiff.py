"""Snapshot differences against sets, with tables that must grow."""

import random
from datetime import datetime, timedelta

from gristmill.operators import snapdiff
from tests.conftest import same_rows

S = "run_id string, unique_id string, node_type string, node_name string, description string, interfaces array<string>, confidence int, loaded_at timestamp, v string"
R = "run_id string, root string, generated_at timestamp, prev string"
T0 = datetime(2026, 1, 1)


def diff(spark, snaps, runs):
    return snapdiff.snapshot_changes(spark.createDataFrame(snaps, S), spark.createDataFrame(runs, R), snapdiff.node_digest())


def test_spelling_order_and_repeats_are_no_difference(spark):
    runs = [("r1", "a", T0, "x"), ("r2", "a", T0 + timedelta(1), "x"), ("r3", "a", T0 + timedelta(2), "x"), ("q1", "b", T0, "x"), ("r2", "a", T0 + timedelta(1), "x"), (None, "a", T0, "x")]
    row = lambda run, uid, name="n", text=None, faces=("p", "q"), conf=1: (run, uid, "t", name, text, list(faces) if faces is not None else None, conf, T0, "x")
    snaps = [row("r1", "u"), row("r1", "v"), row("r1", "u"), row("r2", "u", " n ", "", ("q", "p", "p")), row("r2", "w", conf=None), row("q1", "u"), row(None, "u"), row("r1", None), row("r1", "z", faces=None), row("r2", "z", faces=())]
    same_rows(diff(spark, snaps, runs).collect(), [("r2", "v", "removed"), ("r2", "w", "added"), ("r3", "u", "removed"), ("r3", "w", "removed"), ("r3", "z", "removed")])


def test_everything_changed_in_a_large_run(spark):
    rng = random.Random(2)
    runs = [(f"r{i}", "a", T0 + timedelta(i), "x") for i in range(4)]
    snaps, state, prev, want = [], {}, {}, []
    for i in range(4):
        state = {f"u{rng.randrange(2500)}": rng.randrange(3) for _ in range(1500)} if i != 2 else dict(prev)
        snaps += [(f"r{i}", k, "t", str(v), None, None, v, T0, "x") for k, v in state.items()]
        if i:
            want += [(f"r{i}", k, "removed") for k in prev.keys() - state.keys()] + [(f"r{i}", k, "added") for k in state.keys() - prev.keys()] + [(f"r{i}", k, "changed") for k in state.keys() & prev.keys() if state[k] != prev[k]]
        prev = state
    same_rows(diff(spark, snaps, runs).collect(), want)


def test_many_runs_over_several_blocks_and_a_hot_key(spark):
    n = 3 * snapdiff.BLOCK_RUNS + 5
    runs = [(f"r{i:03d}", "a", T0 + timedelta(i), "x") for i in range(n)]
    snaps = [(f"r{i:03d}", "hot", "t", str(i // 2), None, None, 1, T0, "x") for i in range(n)] + [(f"r{i:03d}", f"u{i // 50}", "t", "s", None, None, 1, T0, "x") for i in range(n)]
    want = [(f"r{i:03d}", "hot", "changed") for i in range(2, n, 2)] + [(f"r{i:03d}", f"u{i // 50 - d}", c) for i in range(50, n, 50) for d, c in ((0, "added"), (1, "removed"))]
    same_rows(diff(spark, snaps, runs).collect(), want)


def test_cells_are_not_shuffled(spark):
    """The rows go over one exchange; tables are built, subtracted and put together where they meet."""
    runs = spark.createDataFrame([(f"r{i}", "a", T0 + timedelta(i), "x") for i in range(2)], R)
    snaps = spark.range(2000).selectExpr("concat('r', id % 2) as run_id", "concat('u', id div 2) as unique_id", "'t' as node_type", "string(if(id < 20, id, 0)) as node_name", "null as description", "array('p') as interfaces", "1 as confidence", "current_timestamp() as loaded_at")
    rows = snapdiff.placed_rows(snaps, snapdiff.run_order(snaps, runs, "run_id", "root", "generated_at"), "run_id", "unique_id", snapdiff.node_digest())
    plan = rows.groupBy(*snapdiff.PLACE, "seq").count()._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    assert snapdiff.snapshot_changes(snaps, runs, snapdiff.node_digest()).count() == 10


def test_empty(spark):
    assert diff(spark, [], []).count() == 0
    assert diff(spark, [], [("r1", "a", T0, "x"), ("r2", "a", T0 + timedelta(1), "x")]).count() == 0
