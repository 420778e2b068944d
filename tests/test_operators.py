"""Gates, bridges, correlation, merge, documents, sinks: one positive, one refusing and one empty case each."""

import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gristmill.operators import catalog, correlate, deploy, documents, evidence, relations, runs
from gristmill.plans import sinks
from gristmill.streaming.merge import merge_stream
from tests.conftest import same_rows


def df(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_matching_is_strict_on_language_and_bounded_by_words(spark):
    s = "reference_name string, match_source string, language string"
    facts = df(spark, s, ("Get", "decorator", "typescript"), ("Getter", "decorator", "typescript"), ("router.get", "decorator", "python"), ("Service", "decorator", "typescript"), ("Service", "decorator", None), (None, "call", "java"), ("Get", None, None))
    got = [(r.reference_name, r.rule_id) for r in evidence.match_signals(facts).collect()]
    same_rows(got, [("Get", "nestjs-verb-decorator"), ("Getter", None), ("router.get", "fastapi-verb-decorator"), ("Service", None), ("Service", "spring-service-stereotype"), (None, None), ("Get", None)])


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.sampled_from([10, 25, 40])), min_size=1, max_size=12), st.randoms())
def test_rollup_does_not_depend_on_order(spark, rows, rng):
    make = lambda xs: spark.createDataFrame([(u, 1, "r", "persistence", w) for u, w in xs], "u string, line int, rule_id string, category string, weight int")
    mixed = list(rows)
    rng.shuffle(mixed)
    a, b = (evidence.rollup(make(x).repartition(3), ["u"]) for x in (rows, mixed))
    same_rows(a.collect(), b.collect())
    kept, low = evidence.floor_split(a)
    assert kept.count() + low.count() == a.count()
    assert {r.u: r.confidence for r in a.collect()} == {u: min(100, sum(w for v, w in rows if v == u)) for u in {u for u, _ in rows}}


def test_gate_first_wins_best_tier_clusters(spark):
    d = df(spark, "k string, c string, o int", ("a", "x", 1), ("a", "x", 2), ("b", "x", 3), ("b", "y", 1), ("c", None, 1))
    same_rows(evidence.exactly_one(d, ["k"], "c").collect(), [("a", 1, "x", "resolved"), ("b", 2, None, "ambiguous"), ("c", 0, None, "zero")])
    same_rows(evidence.first_wins(d, ["k"], ["o"]).collect(), [("a", "x", 1), ("b", "y", 1), ("c", None, 1)])
    assert evidence.best_tier(d, ["k"], F.col("o")).count() == 3
    same_rows(evidence.clusters(d, "k", ["o"], F.col("o").cast("string"), samples=1, top=2).collect(), [("a", 2, "1"), ("b", 2, "1")])


def test_bridge_branches(spark):
    hops = df(spark, "service string, bridge string", *[("s", b) for b in ("one-store", "one-hop", "none-own", "two-stereo", "two-store", "two-stores", "hop-twice", "nothing")])
    imp = df(spark, "bridge string, impl string", ("one-store", "S"), ("one-hop", "i"), ("two-stereo", "S"), ("two-stereo", "T"), ("two-store", "i"), ("two-store", "S"), ("two-stores", "S"), ("two-stores", "U"), ("hop-twice", "j"))
    stores = df(spark, "impl string, stereotype boolean", ("S", False), ("T", True), ("U", False))
    reach = df(spark, "impl string, store string", ("i", "X"), ("j", "X"), ("j", "Y"))
    own = df(spark, "bridge string, store string", ("none-own", "Z"), ("one-store", "Q"))
    got = {r.bridge: (r.mechanism, r.target) for r in relations.resolve_bridges(hops, imp, stores, reach, own).collect()}
    assert got == {"one-store": ("r2-phase1", "S"), "one-hop": ("r2b", "X"), "none-own": ("r2c", "Z"), "two-stereo": ("r2-stereotype", "T"), "two-store": ("tier-b", "S"), "two-stores": ("unresolved", None), "hop-twice": ("unresolved", None), "nothing": ("unresolved", None)}


def test_trust_needs_a_tier(spark):
    e = df(spark, "mechanism string, cross boolean", ("r2b", False), ("r2b", True))
    same_rows([(r.confidence,) for r in catalog.with_trust(e, spark).collect()], [(8,), (5,)])
    with pytest.raises(Exception, match="no trust tier"):
        catalog.with_trust(df(spark, "mechanism string, cross boolean", ("guess", False)), spark).collect()
    assert max(v for k, pair in catalog.TRUST.items() if k.startswith("codeql") for v in pair) < max(v for pair in catalog.TRUST.values() for v in pair)


def test_ancestors_and_cycles(spark):
    e = df(spark, "child string, parent string", ("c", "b"), ("b", "a"), ("x", "y"), ("y", "x"), ("z", None), ("d", "c"))
    got = {r.node: (r.root, r.depth) for r in relations.ancestors(e).collect() if r.node in "bcd"}
    assert got == {"b": ("a", 1), "c": ("a", 2), "d": ("a", 3)}
    assert relations.ancestors(e.where("false")).count() == 0


def test_ancestors_of_long_chains(spark):
    e = df(spark, "child string, parent string", ("x", "y"), ("y", "x"), *[(f"n{i + 1}", f"n{i}") for i in range(300)])
    got = {r.node: (r.root, r.depth) for r in relations.ancestors(e).collect()}
    assert all(got[f"n{i}"] == ("n0", i) for i in range(1, 301)) and got["x"][1] >= 302


def test_correlation(spark):
    rows = df(spark, "id int, n string", (1, "Ledger-Writer"), (2, "userservice"), (3, "xy"), (4, None))
    names = df(spark, "name string, o int", ("ledger", 1), ("ledger-writer", 2), ("user_service", 3))
    got = {r.id: r.match for r in correlate.contained_name(rows, "n", names, "name", "o").collect()}
    assert got == {1: "ledger-writer", 2: "user_service", 3: None, 4: None}
    many = spark.range(20_000).selectExpr("concat('name', id) as name", "id as o")
    hit = correlate.contained_name(df(spark, "id int, n string", (1, "x-name19999-y"), (2, "nam")), "n", many, "name", "o").collect()
    assert {r.id: r.match for r in hit} == {1: "name1", 2: "name0"}
    m = df(spark, "secret string, member string, is_issuer boolean", ("s", "a", True), ("s", "b", False), ("s", "c", False), ("t", "a", True), ("t", "b", True), ("u", "a", True))
    same_rows(correlate.shared_secret_edges(m).collect(), [("s", "a", "b"), ("s", "a", "c")])
    claims, obs = df(spark, "key int, claim string", (1, "a"), (2, "a"), (3, "a"), (4, "a")), df(spark, "key int, value string", (1, "a"), (1, "b"), (2, "b"), (3, "b"), (3, "c"))
    same_rows(correlate.contradictions(claims, obs).select("key", "outcome").collect(), [(1, "agree"), (2, "contradiction"), (3, "ambiguous"), (4, "no-signal")])
    same_rows(correlate.ranked_tier_join(claims, obs, "key", "value", [(F.col("claim"), F.col("value")), (F.lit("k"), F.lit("k"))]).where("value = 'a'").collect(), [(k, "a", 1) for k in (1, 2, 3, 4)])


def test_merge_with_itself_and_history(spark, tmp_path):
    s = "id string, status string, sig string"
    x = df(spark, s, ("a", "reviewed", "1"), ("b", None, "2"), ("c", "observed", None))
    assert {r.outcome for r in runs.incremental_merge(x, x).collect()} == {"unaffected"}
    y = df(spark, s, ("a", "observed", "9"), ("b", "inferred", "2"), ("n", "observed", "3"))
    m = runs.incremental_merge(x, y)
    same_rows(m.collect(), [("a", "flagged", "reviewed", "requires-review"), ("b", "unaffected", None, "inferred"), ("c", "disappeared", "observed", "disappeared"), ("n", "new", "new", "observed")])
    path = str(tmp_path / "h")
    for _ in range(2):
        assert runs.append_history(runs.history(m, F.lit("t")), path, "1") and not runs.append_history(runs.history(runs.incremental_merge(x, x), F.lit("t")), path, "2")
    assert spark.read.parquet(path).count() == 3


def test_scores_of_nothing_are_one(spark):
    s = "predicted boolean, expected boolean"
    assert tuple(runs.precision_recall(df(spark, s)).first()) == (0, 0, 0, 1.0, 1.0, 1.0)
    assert tuple(runs.precision_recall(df(spark, s, (True, True), (True, False), (False, True))).first()) == (1, 1, 1, 0.5, 0.5, 0.5)


def test_deployments(spark):
    d = df(spark, "name string, namespace string, image string, container_name string, config_map_names array<string>, secret_mounts array<struct<secret_name string, item_keys array<string>>>",
           ("orders", "shop", "x/orders:1", "app", ["m"], [("k", ["private.pem", "public.pem"])]), ("ledger", "shop", "x/ledger:1", "app", [], [("k", ["public.pem"])]), ("ledger-db", "shop", "postgres:14", "db", [], []))
    u = df(spark, "unit_id string, file string, kind string, unit_ord int", ("u1", "src/orders.py", "service", 1), ("u2", "src/Ledger.java", "service", 2), ("u3", "src/other.py", "database", 3))
    m = deploy.deployment_units(d, u)
    same_rows(m.collect(), [("orders", "u1"), ("ledger", "u2")])
    same_rows(deploy.trust_edges(d).collect(), [("ledger", "orders")])
    assert deploy.placement_edges(d, m).count() == 2
    keys = df(spark, "config_map string, key string, host string", ("m", "LEDGER_ADDR", None), ("m", "LEDGERDB_URI", None), ("m", "TX_API_ADDR", "ledger"), ("m", "NOPE_URL", None), ("m", "OTHER", None))
    got = {r.key: (r.to_name, r.outcome) for r in deploy.env_edges(d, keys, m).collect()}
    assert got == {"LEDGER_ADDR": ("ledger", "edge"), "LEDGERDB_URI": ("ledger-db", "database"), "TX_API_ADDR": ("ledger", "candidate"), "NOPE_URL": (None, "unresolved")}
    ops = df(spark, "root string, file string, method string, path string", ("r", "o.yaml", "GET", "/a/{id}"), ("q", "o.yaml", "GET", "/a"))
    routes = df(spark, "root string, unit_id string, route string", ("r", "u1", "GET /a/:id"), ("q", "u1", "GET /a"), ("q", "u2", "GET /a"))
    same_rows(deploy.openapi_overlap(ops, routes).collect(), [("r", "o.yaml", "u1", "attached"), ("q", "o.yaml", None, "standalone")])
    props = df(spark, "root string, file string, profile string, doc_profile string, key string, value string", ("r", "a.yml", None, None, "spring.datasource.url", "jdbc:mysql://x"), ("r", "a.yml", None, "prod", "spring.rabbitmq.host", "mq"), ("r", "a.yml", None, None, "server.port", "1"))
    same_rows(deploy.spring_units(props).select("unit_id", "kind", "argument", "scheme").collect(), [("a.yml::datasource", "database", "jdbc:mysql://x", "mysql"), ("a.yml#prod::rabbit", "topic", "mq:5672", None)])


def test_bindings_and_weak_units(spark):
    u = df(spark, "root string, file string, unit_id string, kind string, confidence int", ("r", "a", "ua", "service", 40), ("r", "b", "ub", "database", 95))
    b = df(spark, "root string, from_file string, to_file string, ord int", ("r", "a", "b", 1), ("r", "a", "c", 2), ("r", "a", "c", 3), ("r", "zz", "b", 4))
    edges, new = deploy.bind_edges(b, u, df(spark, "from_id string, to_id string", ("ua", "ub")), F.lit(7))
    same_rows(edges.select("from_id", "to_id", "confidence").collect(), [("ua", "c", 7)])
    same_rows(new.select("unit_id").collect(), [("c",)])
    t = df(spark, "root string, file string, table string", ("r", "b", "t1"), ("r", "b", "t1"), ("r", "b", ""), ("r", "a", "t2"))
    same_rows([(r.unit_id, r.confidence) for r in deploy.enrich_tables(u, t).collect()], [("ua", 40), ("ub", 100)])
    e = df(spark, "root string, file string, unit_id string, category string", ("r", "a", "ua", "framework-bootstrap"), ("r", "b", "ub", "persistence"))
    kept, moved = deploy.replace_weak(u, e, df(spark, "root string, file string, unit_id string", ("r", "a", "topic"), ("r", "b", "x")))
    same_rows([(r.unit_id,) for r in kept.collect()], [("ub",)])
    same_rows([(r.unit_id,) for r in moved.collect()], [("topic",), ("ub",)])


def test_overrides_on_a_document(spark):
    conn = lambda i, a, b: {"unique-id": i, "relationship-type": {"connects": {"source": {"node": a}, "destination": {"node": b}}}}
    node = lambda i: {"unique-id": i, "node-type": "service", "name": i, "description": "d"}
    rows = [
        ("node_add", "c", node("c")), ("node_add", "a", node("a")), ("relationship_add", "bc", conn("bc", "b", "c")), ("relationship_add", "bz", conn("bz", "b", "z")), ("node_rename", "b", "B"), ("type_change", "b", {"to": "x"}),
        ("boundary_change", "b", {"container": "box"}), ("node_remove", "a", None), ("node_remove", "a", None), ("odd", "b", None), ("boundary_change", "c", {"container": "none"}), ("relationship_add", "bc", conn("bc", "b", "c")),
        ("relationship_remove", "ab", None), ("node_add", "a", {**node("a"), "name": "again"}), ("relationship_add", "ab", conn("ab", "b", "a")), ("boundary_change", "b", {"to": "box"}), ("node_add", "d", {"unique-id": "d", "name": "d"}), ("relationship_remove", "bz", None),
        ("node_add", "e", node("e")), ("type_change", "e", "network"), ("node_remove", "e", None), ("node_add", "e", node("e")), ("boundary_change", "e", {"container": None}), ("node_add", "box2", node("box2")), ("boundary_change", "e", {"container": "box2"}), ("node_remove", "box2", None),
    ]
    o = [("A", i, f"O{i:02d}", t, ref, None if v is None else json.dumps(v), "active", "D") for i, (t, ref, v) in enumerate(rows)] + [("A", 90, "O90", "node_remove", "b", None, "retired", "D"), ("A", 91, "O91", "node_remove", "b", None, "active", "gone")]
    nodes = df(spark, "arch_id string, node_id string, node_type string, name string, container string", *[(d, n, "service", n, None) for d in "AB" for n in ("a", "b", "box")])
    rels = df(spark, "arch_id string, rel_id string, from_id string, to_id string", ("A", "ab", "a", "b"), ("B", "ab", "a", "b"))
    over = df(spark, "arch_id string, ord int, override_id string, override_type string, target_ref string, new_value string, status string, decision_record_ref string", *o)
    n, r, log = documents.apply_overrides(nodes, rels, over, df(spark, "decision_id string, status string", ("D", "active"), ("D", "retired")))
    got = {x.node_id: (x.node_type, x.name, x.container, x.n_overrides, x.provenance) for x in n.where("arch_id = 'A'").collect()}
    assert got == {"a": ("service", "again", None, 1, "D"), "b": ("service", "B", "box", 2, "D"), "box": ("service", "box", None, 0, None), "c": ("service", "c", None, 1, "D"), "e": ("service", "e", None, 3, "D")}
    same_rows(r.select("arch_id", "rel_id", "from_id", "to_id", "n_overrides").collect(), [("A", "bc", "b", "c", 1), ("A", "ab", "b", "a", 1), ("B", "ab", "a", "b", 0)])
    fate = [x.outcome for x in sorted(log.collect(), key=lambda x: x.override_id)]
    assert fate == [
        "applied", "rejected", "applied", "orphan", "applied", "rejected", "applied", "applied", "orphan", "rejected", "orphan", "rejected", "orphan", "applied", "applied", "rejected", "rejected", "orphan",
        "applied", "applied", "applied", "applied", "applied", "applied", "applied", "applied", "skipped", "rejected",
    ]
    assert n.where("arch_id = 'B'").count() == 3
    empty = documents.apply_overrides(nodes, rels, over.where("false"), df(spark, "decision_id string, status string"))
    assert (empty[0].count(), empty[1].count(), empty[2].count()) == (6, 2, 0)


def test_greedy_matches_like_a_loop(spark):
    import random

    rng = random.Random(3)
    rows = [("p", f"g{rng.randrange(8)}", f"f{rng.randrange(8)}", rng.randrange(5) / 4) for _ in range(60)] + [("q", "g", f"f{i}", 0.5) for i in range(5)]
    best = {}
    for p, g, f, s in rows:
        best[(p, g, f)] = max(s, best.get((p, g, f), s))
    want, used = [], set()
    for (p, g, f), _ in sorted(best.items(), key=lambda x: (x[0][0], -x[1], x[0][1], x[0][2])):
        if not {(p, "g", g), (p, "f", f)} & used:
            used |= {(p, "g", g), (p, "f", f)}
            want.append((p, g, f))
    pairs = df(spark, "package string, gold string, found string, score double", *rows)
    same_rows(documents.greedy_match(pairs).collect(), want)
    assert documents.greedy_match(pairs.where("false")).count() == 0


def test_projection_and_sinks(spark, tmp_path):
    u = df(spark, "root string, unit_id string, kind string, name string", ("r", "a", "service", "A"), ("r", "b", "topic", "B"), ("r", "x", "odd", "X"))
    nodes, gaps = documents.project_nodes(u)
    rel = df(spark, "root string, id string, from_id string, to_id string, kind string", ("r", "ab", "a", "b", "calls"), ("r", "ax", "a", "x", "calls"), ("r", "an", "a", "k8s-namespace:n", "deployed-in"))
    good, bad = documents.endpoint_integrity(rel, nodes)
    assert [r.id for r in good.collect()] == ["ab"] and {r.id: r.missing for r in bad.collect()} == {"ax": "target", "an": "target"}
    assert tuple(documents.emission_coverage(nodes, gaps).first()) == (2, 1, 0.667) and documents.emission_coverage(nodes.where("false"), gaps.where("false")).first().ratio == 1.0
    assert documents.system_node(nodes).count() == 1 and documents.system_node(nodes.limit(1)).count() == 0
    assert [r.node_id for r in documents.synthetic_nodes(rel).collect()] == ["k8s-namespace:n"]
    doc = json.loads(sinks.architecture_json(nodes, good.select("root", "id", "from_id", "to_id", "kind")).first().doc)
    assert [n["unique-id"] for n in doc["nodes"]] == ["a", "b"] and doc["relationships"][0]["unique-id"] == "ab"
    sinks.write_facts({"units": u}, str(tmp_path / "facts"))
    assert spark.read.parquet(str(tmp_path / "facts/units")).count() == 3
    sinks.write_report(u, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).count() == 3
    sinks.write_run(str(tmp_path / "run"), u, rel, u.where("false"), {"roots": "r"})
    assert json.loads(spark.read.text(str(tmp_path / "run/provenance")).first().value) == {"contractVersion": "17.0.0", "roots": "r"}
    assert {r.fitness for r in sinks.module_report(u, "m", {"exact": "7/7"}).collect()} == {'{"exact":"7/7"}'}
    assert "(1 more)" in sinks.notebook("t", {"units": u}, most=2)
    pairs = df(spark, "package string, gold string, found string, score double", ("p", "g1", "f1", 0.9), ("p", "g1", "f2", 0.8), ("p", "g2", "f1", 0.7), ("p", "g2", "f2", 0.1))
    same_rows(documents.greedy_match(pairs).collect(), [("p", "g1", "f1"), ("p", "g2", "f2")])
    same_rows(documents.number(u, ["root"], ["unit_id"], "R-%03d", "n").select("n").collect(), [("R-000",), ("R-001",), ("R-002",)])


def test_stream_of_runs(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "out")
    s = "run_id string, run_no bigint, n_facts bigint, id string, status string, evidence string"
    put = lambda *rows: df(spark, s, *rows).coalesce(1).write.mode("append").parquet(src)
    go = lambda: merge_stream(spark, src, out).awaitTermination()
    put(("x", 0, 3, "a", "reviewed", "1"))
    put(("x", 0, 3, "b", "observed", "1"), ("y", 1, 2, "a", "observed", "2"))
    go()
    assert not (tmp_path / "out/state").exists()  # a run that is not whole changes nothing
    put(("x", 0, 3, "d", "observed", "1"), ("x", 0, 3, "b", "observed", "1"))
    go()
    same_rows(spark.read.parquet(f"{out}/state/run=0").select("id", "status").collect(), [("a", "reviewed"), ("b", "observed"), ("d", "observed")])
    put(("z", 2, 1, "c", "observed", "1"))
    go()
    put(("y", 1, 2, "c", "observed", "1"))
    go()
    same_rows(spark.read.parquet(f"{out}/state/run=1").select("id", "status").collect(), [("a", "requires-review"), ("c", "observed")])
    same_rows(spark.read.parquet(f"{out}/state/run=2").select("id", "status").collect(), [("c", "observed")])
    n = lambda: spark.read.parquet(f"{out}/history").groupBy("run").count().collect()
    before = n()
    same_rows(before, [(0, 3), (1, 4), (2, 1)])


def test_a_batch_that_comes_twice_changes_nothing(spark, tmp_path):
    from gristmill.streaming.merge import FACTS, merge_batch

    out = str(tmp_path / "out")
    facts = df(spark, FACTS, ("x", 0, 2, "a", "observed", "1"), ("x", 0, 2, "b", "observed", "1"), ("y", 1, 1, "a", "observed", "2"))
    for _ in range(2):
        merge_batch(facts, 0, out)
        same_rows(spark.read.parquet(f"{out}/history").groupBy("run").count().collect(), [(0, 2), (1, 1)])
        same_rows(spark.read.parquet(f"{out}/state/run=1").select("id").collect(), [("a",)])
    (tmp_path / "out/state/run=1/_SUCCESS").unlink()  # as if the batch had failed while it wrote the last state
    merge_batch(facts, 0, out)
    same_rows(spark.read.parquet(f"{out}/history").groupBy("run").count().collect(), [(0, 2), (1, 1)])
