"""Architecture documents from units and relationships, and overrides applied to them in order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.operators.catalog import NODE_TYPES
from gristmill.operators.scan import segmented_last, segmented_sum
from gristmill.session import checkpointed


def project_nodes(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """F-22: (nodes, emission gaps): units of a kind without node type are gaps."""
    typed = units.withColumn("node_type", F.create_map(*[F.lit(x) for kv in NODE_TYPES.items() for x in kv])[F.col("kind")])
    return typed.where("node_type is not null"), typed.where("node_type is null").withColumn("reason", F.lit("UNMAPPED_KIND"))


def endpoint_integrity(rel: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J-27: (relationships whose ends are nodes, gaps with the end that is missing)."""
    n = nodes.select("unit_id").distinct()
    j = rel.join(n.select(F.col("unit_id").alias("from_id"), F.lit(True).alias("_a")), "from_id", "left").join(n.select(F.col("unit_id").alias("to_id"), F.lit(True).alias("_b")), "to_id", "left")
    why = F.when(F.col("_a").isNull() & F.col("_b").isNull(), "both").when(F.col("_a").isNull(), "source").when(F.col("_b").isNull(), "target")
    out = j.withColumn("missing", why).drop("_a", "_b")
    return out.where("missing is null").drop("missing"), out.where("missing is not null")


def emission_coverage(emitted: DataFrame, gaps: DataFrame) -> DataFrame:
    """A-08: one row (emitted, gaps, ratio); without anything the ratio is 1."""
    n = emitted.agg(F.count("*").alias("emitted")).join(gaps.agg(F.count("*").alias("gaps")), F.lit(True))  # one row each
    total = F.col("emitted") + F.col("gaps")
    return n.withColumn("ratio", F.when(total > 0, F.round(F.col("emitted") / total, 3)).otherwise(1.0))


def control_rows(matched: DataFrame, controls: DataFrame) -> DataFrame:
    """A-13: (unit_id, control_id, n_requirements, signals): the evidence of each control of a unit."""
    j = matched.join(F.broadcast(controls), "rule_id")
    return j.groupBy("unit_id", "control_id").agg(F.count("*").alias("n_requirements"), F.array_join(F.array_sort(F.collect_set("reference_name")), "|").alias("signals"))


def system_node(nodes: DataFrame) -> DataFrame:
    """A-10: (system, n_nodes) if there are two nodes or more; the members are the nodes themselves."""
    return nodes.agg(F.count("*").alias("n_nodes")).where("n_nodes >= 2").select(F.lit("system").alias("system"), "n_nodes")


def synthetic_nodes(edges: DataFrame) -> DataFrame:
    """A-11: the distinct namespaces, databases, roots and contracts that edges point to and no unit is."""
    known = F.col("to_id").rlike("^(?:k8s-namespace|k8s-database|repo-root|external-contract):")
    return edges.where(known).select(F.col("to_id").alias("node_id"), F.substring_index("to_id", ":", 1).alias("prefix")).distinct()


def ports(rows: DataFrame) -> DataFrame:
    """A-12: (unit_id, port, ref): each port once, the last of repeated ones."""
    return rows.groupBy("unit_id", "port").agg(F.max_by("ref", "ord").alias("ref"))


def number(rows: DataFrame, keys: list[str], order: list[str], pattern: str, out: str) -> DataFrame:
    """W-04, W-05: rows numbered in order within their keys, from 0, in a ``pattern`` such as 'R-%03d'. (keys, order) must be unique. Keys of any size, and none at all, spread over many tasks."""
    key = keys or ["_all"]
    some = rows if keys else rows.withColumn("_all", F.lit(1))
    n = segmented_sum(some.withColumn("_one", F.lit(1)), key, order, "_one", "_n")
    return n.withColumn(out, F.format_string(pattern, F.col("_n") - 1)).drop("_one", "_n", "_all")


def canonical_rows(rows: DataFrame, by: list[str]) -> DataFrame:
    """W-12: rows in the form and order in which documents are compared: lists as sorted sets, texts without outer spaces, all by ``by`` in binary order."""
    kinds = dict(rows.dtypes)
    tidy = lambda c: F.array_sort(F.array_distinct(F.col(c))) if kinds[c].startswith("array") else F.trim(F.col(c)) if kinds[c] == "string" else F.col(c)
    return rows.select(*(tidy(c).alias(c) for c in rows.columns)).distinct().orderBy(*by)


# The keys of metadata that begin with x-aac- in the two functions below.
def node_metadata(units: DataFrame, evidence: DataFrame, run_version: str) -> DataFrame:
    """F-23: (unit_id, key, ord, value): what is told of each node: its confidence, where its evidence stands, one row each, the run, and its status if it has one. ``units`` (unit_id, confidence, status), ``evidence`` (unit_id, ref)."""
    one = F.array(
        F.struct(F.lit("x-aac-confidence").alias("key"), F.col("confidence").cast("string").alias("value")), F.struct(F.lit("x-aac-run-version").alias("key"), F.lit(run_version).alias("value")),
        F.struct(F.lit("x-aac-status").alias("key"), F.col("status").alias("value")),
    )
    own = units.select("unit_id", F.explode(one).alias("m")).where("m.value is not null").select("unit_id", "m.key", F.lit("").alias("ord"), "m.value")
    refs = evidence.join(units.select("unit_id").distinct(), "unit_id", "left_semi").where("ref is not null").select("unit_id", F.lit("x-aac-provenance").alias("key"), F.col("ref").alias("ord"), F.col("ref").alias("value")).distinct()
    return own.unionByName(refs)


def document_metadata(roots: DataFrame, run_version: str, generated_at: str, limitations: list[str]) -> DataFrame:
    """F-23: (key, ord, value) of a document: its run, its time, its roots, and what such a scan cannot see."""
    spark = roots.sparkSession
    rows = [("x-aac-run-version", "", run_version), ("x-aac-generated-at", "", generated_at), *(("x-aac-scope-limitations", f"{i:04d}", t) for i, t in enumerate(limitations))]
    return spark.createDataFrame(rows, "key string, ord string, value string").unionByName(roots.select(F.lit("x-aac-package-roots").alias("key"), F.col("root").alias("ord"), F.col("root").alias("value")).distinct())


# ---------------------------------------------------------------- overrides

NODE_CHANGES = ["type_change", "node_rename", "boundary_change"]


def apply_overrides(nodes: DataFrame, relationships: DataFrame, overrides: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """U-04: (nodes, relationships, log) after the overrides of each document, as set operations over all documents at once.

    ``nodes`` (arch_id, node_id, node_type, name, container), ``relationships`` (arch_id, rel_id, from_id, to_id), ``overrides`` (arch_id, ord, override_id, override_type, target_ref, new_value, status, decision_record_ref) act in order of ``ord``, ``decisions`` (decision_id, status).
    The result has n_overrides and provenance besides: how many overrides made a row what it is, and the decision of the last.

    Whether a node or relationship is there when an override comes follows from the last one before that added or removed it, so one ordered scan over each of them tells what becomes of every override: log (arch_id, override_id, outcome, reason), outcome one of applied, rejected, skipped, orphan.
    An override that is not active is skipped, one without active decision rejected. node_add needs JSON with unique-id equal to the target, node-type, name and description, relationship_add one that connects two nodes; what exists is not added again, and a relationship to a node that is not there, or any change of one, is an orphan.
    Removing a node removes the relationships that any row of that id ties to it, and lets go of the nodes in it. type_change and node_rename take a JSON string, boundary_change an object with container, null for none, which must be there. Ties of ``ord`` go by override_id.
    """
    active = decisions.groupBy(F.col("decision_id").alias("decision_record_ref")).agg(F.max(F.col("status") == "active").alias("_active"))
    v = F.try_parse_json("new_value")
    o = overrides.join(active, "decision_record_ref", "left").withColumn("v", v).withColumn("kind", F.schema_of_variant("v"))
    at = lambda path: F.try_variant_get("v", path, "string")
    known = ["node_add", "node_remove", "relationship_add", "relationship_remove", *NODE_CHANGES]
    t = F.col("override_type")
    is_text, is_object = F.col("kind").eqNullSafe("STRING"), F.coalesce(F.col("kind").startswith("OBJECT"), F.lit(False))
    a, b = at("$['relationship-type'].connects.source.node"), at("$['relationship-type'].connects.destination.node")
    has = lambda *paths: ~F.concat(*(F.coalesce(F.when(at(p) != "", F.lit("")), F.lit("x")) for p in paths)).contains("x")
    own = at("$['unique-id']") == F.col("target_ref")
    bad = (
        F.when(F.col("status").isNull() | (F.col("status") != "active"), "not active").when(~F.coalesce("_active", F.lit(False)), "no active decision").when(t.isNull() | ~t.isin(*known), "unknown type")
        .when((t == "node_add") & ~F.coalesce(own & has("$['node-type']", "$.name", "$.description"), F.lit(False)), "no valid node")
        .when((t == "relationship_add") & ~F.coalesce(own & a.isNotNull() & b.isNotNull(), F.lit(False)), "no valid relationship")
        .when(t.isin("type_change", "node_rename") & ~is_text, "value must be a string")
        .when((t == "boundary_change") & ~(is_object & F.coalesce(F.array_contains(F.map_keys(F.try_variant_get("v", "$", "map<string,variant>")), "container"), F.lit(False))), "no container")
    )
    o = o.select(
        "arch_id", "ord", "override_id", "target_ref", "override_type", "decision_record_ref", bad.alias("bad"), a.alias("a"), b.alias("b"), at("$").alias("text"), at("$.container").alias("container"), at("$['node-type']").alias("new_type"), at("$.name").alias("new_name")
    )
    o = checkpointed(o)
    good = o.where("bad is null")
    step = ["arch_id", "ord", "override_id"]
    # nodes: what is there when each override looks
    base = nodes.select("arch_id", F.col("node_id").alias("node"), F.lit(None).cast(o.schema["ord"].dataType).alias("ord"), F.lit("").alias("override_id"), F.lit("base").alias("role"), F.lit(True).alias("there"))
    look = lambda df, node, role, there=None: df.select("arch_id", F.col(node).alias("node"), "ord", "override_id", F.lit(role).alias("role"), F.lit(there).cast("boolean").alias("there"))
    adds, gone = good.where("override_type = 'node_add'"), good.where("override_type = 'node_remove'")
    changes, ties = good.where(t.isin(*NODE_CHANGES)), good.where("override_type = 'relationship_add'")
    seen = base.unionByName(look(adds, "target_ref", "self", True)).unionByName(look(gone, "target_ref", "self", False)).unionByName(look(changes, "target_ref", "self"))
    seen = seen.unionByName(look(ties, "a", "a")).unionByName(look(ties, "b", "b")).unionByName(look(changes.where("container is not null"), "container", "box"))
    told = segmented_last(seen, ["arch_id", "node"], ["ord", "override_id", "role"], F.col("there"), "was").where("role <> 'base'").select(*step, "role", F.coalesce("was", F.lit(False)).alias("was"))
    state = told.groupBy(*step).agg(*(F.bool_and(F.when(F.col("role") == r, F.col("was"))).alias(f"_{r}") for r in ("self", "a", "b", "box")))
    j = checkpointed(o.join(state, step, "left"))
    node_fate = F.when(t == "node_add", F.when(F.col("_self"), "rejected: exists").otherwise("applied")).when(~F.col("_self"), "orphan: no such node").when(F.col("_box").eqNullSafe(F.lit(False)), "orphan: no such container").otherwise("applied")
    fated = j.where(F.col("bad").isNull() & ~t.isin("relationship_add", "relationship_remove")).withColumn("fate", node_fate)
    # relationships: added with both ends there, removed by themselves or with a node
    removed = fated.where("override_type = 'node_remove' and fate = 'applied'").select("arch_id", F.col("target_ref").alias("node"), "ord", "override_id")
    whole = j.where("bad is null and override_type = 'relationship_add'").withColumn("whole", F.col("_a") & F.col("_b"))
    ends = relationships.select("arch_id", "rel_id", "from_id", "to_id").unionByName(whole.where("whole").select("arch_id", F.col("target_ref").alias("rel_id"), F.col("a").alias("from_id"), F.col("b").alias("to_id")))
    ends = ends.select("arch_id", "rel_id", F.explode(F.array("from_id", "to_id")).alias("node")).distinct()
    rel = lambda df, rel_id, role, there: df.select("arch_id", F.col(rel_id).alias("rel"), "ord", "override_id", F.lit(role).alias("role"), there.cast("boolean").alias("there"))
    rels = relationships.select("arch_id", F.col("rel_id").alias("rel"), F.lit(None).cast(o.schema["ord"].dataType).alias("ord"), F.lit("").alias("override_id"), F.lit("base").alias("role"), F.lit(True).alias("there"))
    rels = rels.unionByName(rel(whole, "target_ref", "self", F.when(F.col("whole"), F.lit(True)))).unionByName(rel(good.where("override_type = 'relationship_remove'"), "target_ref", "self", F.lit(False)))
    rels = checkpointed(rels.unionByName(rel(removed.join(ends, ["arch_id", "node"]), "rel_id", "swept", F.lit(False)).distinct()))
    held = segmented_last(rels, ["arch_id", "rel"], ["ord", "override_id", "role"], F.col("there"), "was").where("role = 'self'").select(*step, F.coalesce("was", F.lit(False)).alias("_rel"))
    tied = j.where(F.col("bad").isNull() & t.isin("relationship_add", "relationship_remove")).join(held, step, "left")
    rel_fate = F.when(t == "relationship_add", F.when(F.col("_rel"), "rejected: exists").when(~(F.col("_a") & F.col("_b")), "orphan: dangling endpoint").otherwise("applied")).when(F.col("_rel"), "applied").otherwise("orphan: no such relationship")
    cols = [*step, "target_ref", "override_type", "decision_record_ref", "a", "b", "text", "container", "new_type", "new_name", "fate"]
    done = checkpointed(fated.select(cols).unionByName(tied.withColumn("fate", rel_fate).select(cols)))
    split = lambda c: (F.split(c, ": ")[0], F.coalesce(F.get(F.split(c, ": "), F.lit(1)), F.lit("")))
    log = done.select("arch_id", "override_id", split(F.col("fate"))[0].alias("outcome"), split(F.col("fate"))[1].alias("reason")).unionByName(
        o.where("bad is not null").select("arch_id", "override_id", F.when(F.col("bad") == "not active", "skipped").otherwise("rejected").alias("outcome"), F.col("bad").alias("reason"))
    )
    # what is left: the last word on each node since it last came to be
    applied = done.where("fate = 'applied'")
    word = applied.where(t.isin("node_add", "node_remove", *NODE_CHANGES)).select("arch_id", F.col("target_ref").alias("node_id"), F.struct("ord", "override_id").alias("at"), "override_type", "text", "container", "new_type", "new_name", "decision_record_ref")
    life = word.groupBy("arch_id", "node_id").agg(F.max(F.when(F.col("override_type").isin("node_add", "node_remove"), F.col("at"))).alias("born"), F.max_by("override_type", F.when(F.col("override_type").isin("node_add", "node_remove"), F.col("at"))).alias("last"))
    since = word.join(life, ["arch_id", "node_id"]).where(F.col("born").isNull() | (F.col("at") >= F.col("born")))
    pick = lambda kind, c: F.max_by(F.col(c), F.when(F.col("override_type") == kind, F.col("at")))
    final = since.groupBy("arch_id", "node_id").agg(
        F.max("last").alias("last"), pick("node_add", "new_type").alias("t0"), pick("node_add", "new_name").alias("n0"), pick("type_change", "text").alias("t1"), pick("node_rename", "text").alias("n1"), pick("boundary_change", "container").alias("c1"),
        F.max(F.col("override_type") == "boundary_change").alias("moved"), F.count("*").alias("n_overrides"), F.max_by("decision_record_ref", "at").alias("provenance"),
    )
    n = nodes.withColumn("_base", F.lit(True)).join(final, ["arch_id", "node_id"], "full_outer")
    added = F.col("last").eqNullSafe("node_add")
    n = n.where((F.col("_base") & F.col("last").isNull()) | added).select(
        "arch_id", "node_id", F.coalesce("t1", "t0", F.when(~added, F.col("node_type"))).alias("node_type"), F.coalesce("n1", "n0", F.when(~added, F.col("name"))).alias("name"),
        F.when(F.col("moved"), F.col("c1")).when(~added, F.col("container")).alias("container"), F.coalesce("n_overrides", F.lit(0)).alias("n_overrides"), "provenance",
    )
    n = checkpointed(n)
    boxes = n.select("arch_id", F.col("node_id").alias("container"), F.lit(True).alias("_box"))
    out_nodes = n.join(boxes, ["arch_id", "container"], "left").withColumn("container", F.when(F.col("_box"), F.col("container"))).select("arch_id", "node_id", "node_type", "name", "container", "n_overrides", "provenance")
    ended = rels.where("there is not null").groupBy("arch_id", F.col("rel").alias("rel_id")).agg(F.max_by("there", F.struct("ord", "override_id", "role")).alias("there"))
    made = applied.where("override_type = 'relationship_add'").groupBy("arch_id", F.col("target_ref").alias("rel_id")).agg(F.max_by(F.struct("a", "b", "decision_record_ref"), F.struct("ord", "override_id")).alias("m"), F.count("*").alias("n_overrides"))
    r = ended.where("there").select("arch_id", "rel_id").join(relationships, ["arch_id", "rel_id"], "left").join(made, ["arch_id", "rel_id"], "left")
    out_rels = r.select("arch_id", "rel_id", F.coalesce("m.a", "from_id").alias("from_id"), F.coalesce("m.b", "to_id").alias("to_id"), F.coalesce("n_overrides", F.lit(0)).alias("n_overrides"), F.col("m.decision_record_ref").alias("provenance"))
    return out_nodes, out_rels, log


def greedy_match(pairs: DataFrame) -> DataFrame:
    """W-13, A-16: (package, gold, found): one-to-one matches of ``pairs`` (package, gold, found, score), best score first, each side used once; equal scores go by gold, then found.

    A pair that is the best of both its sides is what the greedy order would take, so all such pairs are taken at once, what they use is dropped, and this is done until none is left: packages of any size spread over many tasks.
    """
    left = checkpointed(pairs.groupBy("package", "gold", "found").agg((-F.max("score")).alias("s")))
    taken = None
    while not left.isEmpty():
        rank = F.struct("s", "gold", "found")
        a = left.groupBy("package", "gold").agg(F.min(rank).alias("m")).select("package", "m.*")
        b = left.groupBy("package", "found").agg(F.min(rank).alias("m")).select("package", "m.*")
        now = checkpointed(a.join(b, ["package", "s", "gold", "found"], "left_semi").select("package", "gold", "found"))
        taken = now if taken is None else taken.unionByName(now)
        left = checkpointed(left.join(now.select("package", "gold"), ["package", "gold"], "left_anti").join(now.select("package", "found"), ["package", "found"], "left_anti"))
    return taken if taken is not None else left.select("package", "gold", "found")
