"""Relationships between units: reconciled edges, bounded bridges, admissions, grades, duplicates, graph rewrites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gristmill.functions.text import relationship_id
from gristmill.operators.evidence import first_wins
from gristmill.session import checkpointed

# Kind of a relationship by the relation of the edge; any other connects.
KINDS = {"imports": "imports", "imports_from": "imports", "calls": "calls"}


def node_to_unit(nodes: DataFrame, units: DataFrame) -> DataFrame:
    """J-04: (node_id, unit_id): the unit of the node's (root, file), the one whose lines hold the node's line if there are several, else the first.

    ``nodes`` (node_id, root, file, line), ``units`` (unit_id, root, file, start_line, end_line, unit_ord).
    """
    j = nodes.join(units, ["root", "file"])
    outside = ~F.col("line").between(F.col("start_line"), F.col("end_line"))
    return j.groupBy("node_id").agg(F.min_by("unit_id", F.struct(F.coalesce(outside, F.lit(True)), "unit_ord")).alias("unit_id"))


def reconcile(edges: DataFrame, node_units: DataFrame, unit_roots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J-05: (relationships, edges with an end that is no unit).

    ``edges`` (source, target, relation, ord). Both ends go to units; edges inside a unit are dropped; of equal (from, to, kind, cross) the first counts.
    """
    a = node_units.select(F.col("node_id").alias("source"), F.col("unit_id").alias("from_id"))
    b = node_units.select(F.col("node_id").alias("target"), F.col("unit_id").alias("to_id"))
    j = edges.join(a, "source", "left").join(b, "target", "left")
    whole = j.where("from_id is not null and to_id is not null and from_id <> to_id")
    kind = F.coalesce(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("relation")], F.lit("connects"))
    r = unit_roots
    rooted = whole.join(r.select(F.col("unit_id").alias("from_id"), F.col("root").alias("_ra")), "from_id").join(r.select(F.col("unit_id").alias("to_id"), F.col("root").alias("_rb")), "to_id")
    rel = first_wins(rooted.select("from_id", "to_id", kind.alias("kind"), (F.col("_ra") != F.col("_rb")).alias("cross"), "ord", "relation"), ["from_id", "to_id", "kind", "cross"], ["ord"])
    return rel, j.where("from_id is null or to_id is null")


def admit_unresolved(half: DataFrame, reserved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J-06: (admitted edges, dropped edges). An edge with just one unit gets a placeholder at its other end, unless its (source, target) is reserved; with none it is dropped."""
    one = F.col("from_id").isNull() != F.col("to_id").isNull()
    free = half.where(one).join(reserved.select("source", "target").distinct(), ["source", "target"], "left_anti")
    admitted = free.select("source", "target", F.coalesce("from_id", F.concat(F.lit("unresolved:"), F.col("source"))).alias("from_id"), F.coalesce("to_id", F.concat(F.lit("unresolved:"), F.col("target"))).alias("to_id"), "ord")
    return admitted, half.join(admitted.select("source", "target").distinct(), ["source", "target"], "left_anti")


def resolve_bridges(hops: DataFrame, implementers: DataFrame, stores: DataFrame, reach: DataFrame, own: DataFrame) -> DataFrame:
    """J-08: what each (service, bridge) of ``hops`` resolves to, in two bounded hops: (service, bridge, mechanism, target).

    ``implementers`` (bridge, impl), ``stores`` (impl, stereotype), ``reach`` (impl, store) the stores an implementer imports, ``own`` (bridge, store) those a bridge itself imports.
    One implementer: a store is r2-phase1, and a non-store that reaches just one store r2b. None: a bridge that imports just one store is r2c. Several: the only one with the
    stereotype, if it is a store, is r2-stereotype; the only store among them is kept for review as tier-b. Everything else is unresolved; there is never a third hop.
    """
    marked = implementers.distinct().join(stores.groupBy("impl").agg(F.bool_or("stereotype").alias("stereotype"), F.lit(True).alias("is_store")), "impl", "left")
    store = F.coalesce(F.col("is_store"), F.lit(False))
    stereo = F.coalesce(F.col("stereotype"), F.lit(False))
    impl = marked.groupBy("bridge").agg(
        F.count_distinct("impl").alias("n_impl"), F.min("impl").alias("impl"), F.count_if(store).alias("n_store"), F.min(F.when(store, F.col("impl"))).alias("store_impl"),
        F.count_if(stereo).alias("n_stereo"), F.min(F.when(stereo & store, F.col("impl"))).alias("stereo_impl"),
    )
    hop = reach.groupBy("impl").agg(F.count_distinct("store").alias("n_reach"), F.min("store").alias("reach"))
    direct = own.groupBy("bridge").agg(F.count_distinct("store").alias("n_own"), F.min("store").alias("own"))
    j = hops.distinct().join(impl, "bridge", "left").join(hop, "impl", "left").join(direct, "bridge", "left")
    n = F.coalesce("n_impl", F.lit(0))
    rules = [
        ((n == 1) & (F.col("n_store") == 1), "r2-phase1", "impl"),
        ((n == 1) & (F.col("n_store") == 0) & (F.coalesce("n_reach", F.lit(0)) == 1), "r2b", "reach"),
        ((n == 0) & (F.coalesce("n_own", F.lit(0)) == 1), "r2c", "own"),
        ((n >= 2) & (F.col("n_stereo") == 1) & F.col("stereo_impl").isNotNull(), "r2-stereotype", "stereo_impl"),
        ((n >= 2) & (F.col("n_store") == 1), "tier-b", "store_impl"),
    ]
    mechanism, target = F.lit("unresolved"), F.lit(None).cast("string")
    for cond, name, col in reversed(rules):
        mechanism, target = F.when(cond, name).otherwise(mechanism), F.when(cond, F.col(col).cast("string")).otherwise(target)
    return j.select("service", "bridge", mechanism.alias("mechanism"), target.alias("target"))


def grade(kind: Column, source: Column, from_kind: Column, to_kind: Column) -> Column:
    """F-14: shared secrets are trust; placement, manifests and unresolved ends structural; an edge with a service end architecture; else structural."""
    structural = (kind == "deployed-in") | (source == "repo-manifest") | (from_kind == "unresolved") | (to_kind == "unresolved")
    return F.when(kind == "shares-secret", "trust").when(F.coalesce(structural, F.lit(False)), "structural").when(F.coalesce((from_kind == "service") | (to_kind == "service"), F.lit(False)), "architecture").otherwise("structural")


def unit_status(kind: Column, only_secondary: Column, contradicted: Column, has_contract: Column, confidence: Column) -> Column:
    """F-15: ``only_secondary`` of a unit without evidence is true."""
    review = (kind == "unresolved") | F.coalesce(only_secondary, F.lit(True)) | F.coalesce(contradicted, F.lit(False))
    return F.when(review, "requires-review").when(F.coalesce(has_contract, F.lit(False)), "externally-verified").when(confidence >= 70, "observed").otherwise("inferred")


def relationship_status(source: Column, mechanism: Column, end_in_review: Column, confidence: Column) -> Column:
    """F-16."""
    return F.when(source == "k8s", "externally-verified").when(F.coalesce((source == "repo-manifest") | (mechanism == "admitted-unresolved") | end_in_review, F.lit(False)), "requires-review").when(confidence.isNotNull(), "inferred").otherwise("observed")


def merge_duplicates(rel: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """A-09: one row for each key; each value alone if all agree, else all distinct ones in order, as text."""
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(F.col(c).cast("string"))), "|")
    return rel.groupBy(*keys).agg(F.count("*").alias("n_merged"), *(joined(v).alias(v) for v in values))


def with_identity(rel: DataFrame) -> DataFrame:
    """``rel`` (kind, from_id, to_id, mechanism, source) with an id made of its content."""
    return rel.withColumn("id", relationship_id(F.col("kind"), F.col("from_id"), F.col("to_id"), F.col("mechanism"), F.col("source")))


def reparent_members(edges: DataFrame, members: DataFrame) -> DataFrame:
    """S-26: ends that are members become their classes, but on edges that say membership. ``members`` (member, owner)."""
    m = members.groupBy("member").agg(F.min("owner").alias("owner"))
    j = edges.join(m.select(F.col("member").alias("source"), F.col("owner").alias("_a")), "source", "left").join(m.select(F.col("member").alias("target"), F.col("owner").alias("_b")), "target", "left")
    keep = F.col("relation").isin("contains", "method")
    cols = [c for c in edges.columns if c not in ("source", "target")]
    return j.select(F.when(keep, F.col("source")).otherwise(F.coalesce("_a", "source")).alias("source"), F.when(keep, F.col("target")).otherwise(F.coalesce("_b", "target")).alias("target"), *cols)


def ancestors(edges: DataFrame) -> DataFrame:
    """S-16, S-25: (node, root, depth): the topmost parent of every node of ``edges`` (child, parent), by pointer doubling, for chains of any length.

    A walk of as many steps as there are nodes with a parent that can still go on is in a cycle; such nodes come out with that depth or more and some node of the cycle.
    A node's hot parent makes no pairs: each node has one parent, the least if several are given.
    """
    one = edges.where("child is not null and parent is not null and child <> parent").groupBy("child").agg(F.min("parent").alias("parent"))
    now = checkpointed(one.select(F.col("child").alias("node"), F.col("parent").alias("top"), F.lit(1).alias("depth")))
    limit = now.count()
    while True:
        up = now.select(F.col("node").alias("top"), F.col("top").alias("_t"), F.col("depth").alias("_d"))
        step = checkpointed(now.join(up, "top", "left").select("node", F.coalesce("_t", "top").alias("top"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"), F.col("_t").isNotNull().alias("moved")))
        if step.where(f"moved and depth < {limit}").isEmpty():
            return step.select("node", F.col("top").alias("root"), "depth")
        now = step.drop("moved")


# ---------------------------------------------------------------- one graph over all roots


def code_graph(facts: DataFrame, imports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S-07: (nodes, edges) over all roots at once: nodes (id, label, kind, root, file, line), edges (source, target, relation, root, file, line).

    Nodes are files, the classes and methods in which facts stand, and imports; files contain classes and imports, classes contain methods, and what a fact names is referred to by name, by the relation of its kind. Edges that
    contain have no line of their own. ``facts`` (root, file, line, match_source, reference_name, from_node_id, from_node_kind, from_node_name), ``imports`` (root, file, line, qualified).
    """
    file_id = F.concat(F.lit("file:"), "root", F.lit(":"), "file")
    member = F.concat("from_node_id", F.lit("."), "from_node_name")
    import_id = F.concat(F.lit("import:"), "root", F.lit(":"), "file", F.lit(":"), "qualified")
    known = facts.where("from_node_id is not null and from_node_name is not null")
    node = lambda df, i, label, kind: df.groupBy(i.alias("id"), "root", "file").agg(F.min(label).alias("label"), F.min("line").alias("line")).select("id", "label", F.lit(kind).alias("kind"), "root", "file", "line")
    methods = known.where("from_node_kind = 'method'")
    class_name = F.regexp_extract("from_node_id", "#([^#]*)$", 1)
    files = facts.select("root", "file").unionByName(imports.select("root", "file")).distinct().withColumn("line", F.lit(1))
    nodes = node(files, file_id, F.col("file"), "file").unionByName(node(known, F.col("from_node_id"), class_name, "class")).unionByName(node(methods, member, F.col("from_node_name"), "method")).unionByName(node(imports, import_id, F.col("qualified"), "import"))
    edge = lambda df, a, b, relation, line=None: df.select(a.alias("source"), b.alias("target"), relation.alias("relation"), "root", "file", (F.lit(None).cast("int") if line is None else F.col(line).cast("int")).alias("line")).distinct()
    holds = F.lit("contains")
    relation = F.when(F.col("match_source") == "call", "calls").when(F.col("match_source") == "extends", "extends").otherwise("references")
    edges = edge(known, file_id, F.col("from_node_id"), holds).unionByName(edge(methods, F.col("from_node_id"), member, holds)).unionByName(edge(imports, file_id, import_id, holds))
    return nodes, edges.unionByName(edge(known, F.when(F.col("from_node_kind") == "method", member).otherwise(F.col("from_node_id")), F.col("reference_name"), relation, "line"))


def normalize_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """S-08: containing an import is importing its bare name, containing a method is having it, all else stays; an edge without line has that of the import it names, else that of its source."""
    n = nodes.groupBy("id").agg(F.min(F.struct("kind", "label", "line")).alias("n"))
    j = edges.join(n.select(F.col("id").alias("target"), F.col("n").alias("_t")), "target", "left").join(n.select(F.col("id").alias("source"), F.col("n").alias("_s")), "source", "left")
    inside = F.col("relation") == "contains"
    imported = inside & F.col("_t.kind").eqNullSafe("import")
    relation = F.when(imported, "imports").when(inside & F.col("_t.kind").eqNullSafe("method"), "method").otherwise(F.col("relation"))
    line = F.coalesce("line", F.when(imported, F.col("_t.line")), F.col("_s.line"))
    return j.select("source", F.when(imported, F.col("_t.label")).otherwise(F.col("target")).alias("target"), relation.alias("relation"), "root", "file", line.cast("int").alias("line"))


def di_resolution(fields: DataFrame, stereotypes: DataFrame, beans: DataFrame) -> DataFrame:
    """J-25: (root, owner, field, interface, impl, mechanism): what is injected into the final fields of an interface's type.

    ``stereotypes`` (root, interface, impl) are implementers with a stereotype, ``beans`` what factory methods return; each counts only where it is the only one for its interface (J-07), and both may hold. ``fields`` (root, owner, field, interface, is_final).
    """
    out = None
    for name, found in (("stereotype", stereotypes), ("bean-factory", beans)):
        one = found.groupBy("root", "interface").agg(F.count_distinct("impl").alias("_n"), F.min("impl").alias("impl")).where("_n = 1").drop("_n")
        part = fields.where("is_final").join(one, ["root", "interface"]).select("root", "owner", "field", "interface", "impl", F.lit(name).alias("mechanism"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def named_bindings(fields: DataFrame, named: DataFrame) -> DataFrame:
    """J-26: (root, owner, field, interface, impl, mechanism, qualifier) of injected fields and named implementers: the only implementer of a plain field, all of a collection, and those with a qualifier of a map.

    ``fields`` (root, owner, field, interface, shape), shape one of plain, map, collection; ``named`` (root, interface, impl, qualifier), an empty qualifier where there is none.
    """
    n = named.distinct()
    single = n.groupBy("root", "interface").agg(F.count_distinct("impl").alias("_n"), F.min(F.struct("impl", "qualifier")).alias("_m")).where("_n = 1").select("root", "interface", "_m.impl", "_m.qualifier")
    cols = ["root", "owner", "field", "interface", "impl", "mechanism", "qualifier"]
    parts = [
        fields.where("shape = 'plain'").join(single, ["root", "interface"]).withColumn("mechanism", F.lit("single-implementer")),
        fields.where("shape = 'map'").join(n.where("qualifier <> ''"), ["root", "interface"]).withColumn("mechanism", F.lit("map-role-hint")),
        fields.where("shape = 'collection'").join(n, ["root", "interface"]).withColumn("mechanism", F.lit("collection-multibind")),
    ]
    return parts[0].select(cols).unionByName(parts[1].select(cols)).unionByName(parts[2].select(cols)).distinct()


def entity_tables(decorators: DataFrame) -> DataFrame:
    """J-26: (root, file, class, table) of entities with a table's name written out; ``decorators`` (root, file, from_node_id, from_node_kind, from_node_name, reference_name, argument)."""
    own = decorators.where("from_node_kind = 'class'")
    name = F.regexp_replace("argument", "^[^\"']*[\"']|[\"'].*$", "")
    tables = own.where("reference_name = 'Table' and argument is not null and argument <> ''").select("root", "file", "from_node_id", F.col("from_node_name").alias("class"), name.alias("table"))
    return tables.join(own.where("reference_name = 'Entity'").select("from_node_id").distinct(), "from_node_id", "left_semi").select("root", "file", "class", "table").distinct()
