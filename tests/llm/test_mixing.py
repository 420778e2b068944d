"""The mix: plans, caps, shares and balance."""

import random

from gristmill.llm import mixing as M

T = "source string, target_share double, max_repeats int, tokens int"


def test_plan():
    rates = M.plan_mix({"a": 1000, "b": 100, "c": 0}, {"a": (0.5, 1), "b": (0.4, 2), "c": (0.1, 3)})
    assert rates["b"] == 2.0 and rates["c"] == 0.0 and abs(rates["a"] - 0.9) < 1e-9
    assert M.plan_mix({"a": 10}, {"a": (1.0, 2)}, total=1000) == {"a": 2.0}
    assert M.plan_mix({}, {"a": (1.0, 2)}) == {"a": 0.0}
    assert M.plan_mix({"a": 100, "b": 100}, {"a": (0.25, 9), "b": (0.75, 9)}) == {"a": 0.5, "b": 1.5}


def test_flight_keeps_totals_and_expectations():
    rng = random.Random(4)
    units = [[i, float(rng.randrange(1, 500)), 0.3] for i in range(2000)]
    want = sum(u[1] * 0.3 for u in units)
    out = list(M.fly(iter([list(u) for u in units]), random.Random(1)))
    assert sum(0 < u[2] < 1 for u in out) <= 2 and len(out) == 2000
    assert abs(sum(u[2] for u in out) - 600) < 1e-6 and abs(sum(u[1] * u[2] for u in out) - want) < 1e-3
    landed = list(M.fly(iter([list(u) for u in units]), random.Random(1), last=True))
    assert all(u[2] in (0.0, 1.0) for u in landed) and abs(sum(u[2] for u in landed) - 600) <= 1
    often = [0] * 6
    for seed in range(2000):
        for u in M.fly(iter([[i, float(i * i + 1), 0.5] for i in range(6)]), random.Random(seed), last=True):
            often[u[0]] += int(u[2])
    assert all(850 < n < 1150 for n in often)


def docs(spark, n=900):
    rng = random.Random(2)
    rows = [(i, "word " * rng.randrange(1, 60) if i % 50 else rng.choice([None, "", " "]), "big" if i % 3 else rng.choice(["mid", "small", None, "other"]), "clash") for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, copies string")


def test_shares_caps_and_determinism(spark, monkeypatch):
    monkeypatch.setattr(M, "BLOCK_DOCS", 40)
    monkeypatch.setattr(M, "FAN_IN", 4)
    targets = spark.createDataFrame([("big", 0.5, 1, 0), ("mid", 0.3, 3, 0), ("small", 0.15, 2, 0), ("absent", 0.05, 2, 0), (None, 0.1, 1, 0), ("big", 0.5, 1, 0)], T)
    d = docs(spark)
    a = M.mix_sources(d, targets).collect()
    b = M.mix_sources(d.repartition(7), targets).collect()
    assert sorted(a) == sorted(b) and len({r.doc_id for r in a}) == len(a) and all(r.n_tokens > 0 for r in a)
    assert all(1 <= r.copies <= {"big": 1, "mid": 3, "small": 2}[r.source] for r in a)
    sizes = {s: sum(r.n_tokens for r in M.count_tokens(d.where(f"source = '{s}'")).collect()) for s in ("big", "mid", "small")}
    rates = M.plan_mix(sizes, {"big": (0.5, 1), "mid": (0.3, 3), "small": (0.15, 2), "absent": (0.05, 2)})
    for s, n in sizes.items():
        assert abs(sum(r.copies * r.n_tokens for r in a if r.source == s) - rates[s] * n) <= 120
    shares = {r.source: r for r in M.mix_shares(M.mix_sources(d, targets), targets).collect()}
    assert shares["absent"].tokens == 0 and abs(sum(r.actual_share for r in shares.values() if r.source in sizes) - 1) < 1e-4


def test_empty(spark):
    targets = spark.createDataFrame([("big", 1.0, 1, 0)], T)
    assert M.mix_sources(docs(spark).where("false"), targets).count() == 0
    assert M.mix_sources(docs(spark, 30), targets.where("false")).count() == 0
