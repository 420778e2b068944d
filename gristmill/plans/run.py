"""A whole run: from source trees to facts, coverage and the review queue, as a chain of passes over named frames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import catalog, coverage, deploy, evidence, relations, review, runs
from gristmill.plans import sinks
from gristmill.session import checkpointed
from gristmill.sources import manifests, trees


@dataclass(frozen=True)
class Run:
    """What a run knows so far. A pass takes one and gives the next; nothing is changed in place."""

    spark: SparkSession
    roots: list[str]
    options: dict[str, str] = field(default_factory=dict)
    frames: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.frames[name]

    def put(self, **frames: DataFrame) -> Run:
        return replace(self, frames=self.frames | frames)


Pass = Callable[[Run], Run]
NO_UNITS = "root string, file string, unit_id string, name string, kind string, confidence bigint, start_line bigint, end_line bigint"


def read(r: Run) -> Run:
    """Files of all roots as tables; test code is left aside, with its reason."""
    every = reduce(DataFrame.unionByName, [trees.read_files(r.spark, p) for p in r.roots])
    whole = checkpointed(trees.resolve_roots(every, r.roots))
    product, test = evidence.split_test_paths(trees.source_files(whole))
    lines = trees.source_lines(whole.join(product.select("root", "file"), ["root", "file"], "left_semi"))
    return r.put(texts=whole, files=product, lines=checkpointed(lines), ignored=test.select("root", F.col("file").alias("ref"), F.lit("TEST_CODE").alias("reason"), F.lit(None).cast("string").alias("detail")))


def facts(r: Run) -> Run:
    """Routes, decorators, calls, types and bases of all lines, each with the class it stands in and the language of its file."""
    code = r["lines"].join(trees.indexed_files(r["files"]).select("root", "file"), ["root", "file"], "left_semi")
    found = [trees.decorator_facts(code), trees.call_facts(code), trees.type_references(code), trees.extends_facts(code)]
    facts = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), found).distinct()
    classes = trees.class_headers(code).select("root", "file", "line", "name")
    rank = F.xxhash64("match_source", "reference_name", F.coalesce("argument", F.lit("")))
    marked = facts.withColumn("rank", rank).withColumn("name", F.lit(None).cast("string")).unionByName(classes.withColumn("rank", F.lit(-(1 << 62))), allowMissingColumns=True)
    seen = evidence.nearest_preceding(marked, ["root", "file"], ["line", "rank"], F.col("name").isNotNull(), F.col("name"), "from_node_name").where("reference_name is not null")
    # a decorator right above a class belongs to it
    own = classes.select("root", "file", F.explode(F.sequence(F.greatest(F.col("line") - 3, F.lit(1)), F.col("line"))).alias("line"), F.col("name").alias("_class")).groupBy("root", "file", "line").agg(F.min("_class").alias("_class"))
    j = seen.join(own, ["root", "file", "line"], "left").join(r["files"].select("root", "file", "language"), ["root", "file"], "left")
    on_class = F.col("_class").isNotNull() & (F.col("match_source") != "call")
    facts = j.select("root", "file", "line", "match_source", "reference_name", "argument", "language", F.coalesce("_class", "from_node_name").alias("from_node_name"), F.when(on_class, "class").otherwise("method").alias("from_node_kind")).withColumn("from_node_id", F.concat_ws(":", "root", F.concat_ws("#", "file", "from_node_name")))
    return r.put(facts=checkpointed(facts), classes=classes, routes=trees.native_routes(code), imports=evidence.java_imports(code))


def signals(r: Run) -> Run:
    """Facts that rules explain become units by file; what no rule knows, and what is too weak, is told."""
    matched = evidence.match_signals(r["facts"])
    native = r["routes"].select("root", "file", F.col("start_line").alias("line"), F.lit("native-route").alias("match_source"), F.col("name").alias("reference_name"), F.lit("native-route").alias("rule_id"), F.lit("http-entry-point").alias("category"), F.lit(40).alias("weight"))
    seen = checkpointed(matched.unionByName(native, allowMissingColumns=True))
    named = F.when(F.col("from_node_kind") == "class", F.col("from_node_name"))
    units = evidence.rollup(seen, ["root", "file"], class_name=named, path="file").withColumn("unit_id", F.col("file"))
    kept, low = evidence.floor_split(units)
    unknown = evidence.suppress_route_lines(seen.where("rule_id is null and match_source = 'decorator'"), r["routes"])
    ref = F.concat_ws(":", "file", "line").alias("ref")
    why = F.concat(F.lit('no rule for "'), "reference_name", F.lit('"')).alias("detail")
    told = unknown.select("root", ref, F.lit("INSUFFICIENT_EVIDENCE").alias("reason"), why).distinct().unionByName(low.select("root", F.col("file").alias("ref"), "reason", F.format_string("confidence %d", "confidence").alias("detail")))
    told = told.unionByName(evidence.resilience_candidates(r["facts"]))
    return r.put(evidence=seen.where("rule_id is not null"), units=kept.select([c.split()[0] for c in NO_UNITS.split(", ")]), ignored=r["ignored"].unionByName(told))


def libraries(r: Run) -> Run:
    """Units of classes that import a store, and clients of unknown targets."""
    imports = r["imports"].select("root", "file", F.col("qualified").alias("target"), F.lit("java").alias("language"))
    stores = trees.library_imports(imports, catalog.STORE_LIBRARIES, F.col("language"))
    last = r["facts"].groupBy("root", "file").agg(F.max("line").alias("last_line"))
    wired = reduce(DataFrame.unionByName, [trees.annotated_classes(r["lines"], a) for a in catalog.WIRING])
    fields = [r["classes"].join(trees.has_field_of(r["lines"], t), ["root", "file"], "left_semi").select("root", "file", "name", F.lit(lib).alias("library")) for lib, t in catalog.OWNER_FIELDS.items()]
    found = review.import_units(stores, r["classes"].join(last, ["root", "file"], "left"), r["units"], "database", wired, reduce(DataFrame.unionByName, fields), list(catalog.OWNER_FIELDS))
    new = found.select("root", "file", F.concat_ws("::", "file", "name").alias("unit_id"), "name", "kind", F.col("confidence").cast("bigint").alias("confidence"), F.col("start_line").cast("bigint").alias("start_line"), F.col("end_line").cast("bigint").alias("end_line"))
    clients = trees.library_imports(imports, catalog.HTTP_CLIENTS, F.col("language"))
    calls = review.outbound_http(clients, F.lit(True), F.lit(False)).select("root", "ref", "reason", F.col("ref").alias("detail"))
    return r.put(units=evidence.with_exempt(r["units"], new), ignored=r["ignored"].unionByName(calls))


def configuration(r: Run) -> Run:
    """Stores and brokers that configuration names."""
    u = deploy.spring_units(manifests.spring_properties(r["texts"]))
    return r.put(units=checkpointed(evidence.with_exempt(r["units"], u.select("root", "file", "unit_id", F.col("argument").alias("name"), "kind", F.col("weight").cast("bigint").alias("confidence"), F.lit(0).cast("bigint").alias("start_line"), F.lit(0).cast("bigint").alias("end_line")))))


def graph(r: Run) -> Run:
    """Relationships between units: a file that imports, calls or refers to a class is tied to its unit, where just one unit has that class."""
    nodes, edges = relations.code_graph(r["facts"], r["imports"])
    owner = r["units"].select("root", "file", "unit_id", "kind")
    target = F.regexp_extract("target", r"([^.]+)$", 1)
    classes = r["classes"].join(owner, ["root", "file"]).select(F.col("name").alias("bare"), "unit_id")
    one = evidence.exactly_one(classes, ["bare"], "unit_id").where("outcome = 'resolved'").select("bare", F.col("unit_id").alias("to_id"))
    tied = relations.normalize_edges(edges, nodes).where("relation in ('imports', 'calls', 'references', 'extends')").withColumn("bare", target).join(one, "bare")
    j = tied.join(owner.select("root", "file", F.col("unit_id").alias("from_id")), ["root", "file"]).where("from_id <> to_id")
    kind = F.when(F.col("relation").isin("imports", "calls"), F.col("relation")).otherwise("connects")
    rel = evidence.first_wins(j.select("from_id", "to_id", kind.alias("kind"), "root", F.coalesce("line", F.lit(0)).alias("line"), "file"), ["from_id", "to_id", "kind"], ["root", "file", "line"])
    return r.put(relationships=rel.select("root", "from_id", "to_id", "kind").withColumn("source", F.lit("graph")).withColumn("mechanism", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("bigint")))


def placement(r: Run) -> Run:
    """Deployments of manifests at their units, if a folder of manifests was given."""
    if not (path := r.options.get("k8s_manifests")):
        return r
    files = trees.read_files(r.spark, path).select(F.lit("k8s").alias("root"), F.col("path").alias("file"), "text")
    d = manifests.k8s_deployments(files)
    units = r["units"].select("unit_id", "file", "kind", F.col("unit_id").alias("unit_ord"))
    e = deploy.placement_edges(d, deploy.deployment_units(d, units)).select(F.lit("k8s").alias("root"), F.col("unit_id").alias("from_id"), F.col("node").alias("to_id"), F.lit("deployed-in").alias("kind"), F.lit("k8s").alias("source"), F.lit(None).cast("string").alias("mechanism"), F.lit(None).cast("bigint").alias("confidence"))
    return r.put(relationships=r["relationships"].unionByName(e))


def judge(r: Run) -> Run:
    """Grades, ids and status; always last."""
    kinds = r["units"].select("unit_id", "kind").distinct()
    k = lambda c, out: kinds.select(F.col("unit_id").alias(c), F.col("kind").alias(out))
    j = r["relationships"].join(k("from_id", "_a"), "from_id", "left").join(k("to_id", "_b"), "to_id", "left")
    rel = relations.with_identity(j.withColumn("grade", relations.grade(F.col("kind"), F.col("source"), F.col("_a"), F.col("_b")))).withColumn("status", relations.relationship_status(F.col("source"), F.col("mechanism"), F.lit(False), F.col("confidence"))).drop("_a", "_b")
    no = F.lit(False)
    return r.put(relationships=checkpointed(rel), units=checkpointed(r["units"].withColumn("status", relations.unit_status(F.col("kind"), no, no, no, F.col("confidence")))))


#: The order is that of what each pass needs; nothing else depends on it.
PASSES: list[tuple[str, Pass]] = [("read", read), ("facts", facts), ("signals", signals), ("libraries", libraries), ("configuration", configuration), ("graph", graph), ("placement", placement), ("judge", judge)]


def report(r: Run) -> Run:
    """Completeness, flags and the review queue of the run."""
    has = lambda c: F.coalesce(F.bool_or(F.col("category") == c), F.lit(False))
    flags = r["evidence"].groupBy("root", "file").agg(has("http-entry-point").alias("has_http"), has("security-control").alias("has_control"), has("messaging").alias("has_messaging"))
    false = F.lit(False)
    u = r["units"].join(flags, ["root", "file"], "left").select(F.lit("run").alias("run"), "unit_id", "file", "kind", "confidence", *(F.coalesce(c, false).alias(c) for c in ("has_http", "has_control", "has_messaging")))
    rel = r["relationships"].select(F.lit("run").alias("run"), "id", "from_id", "to_id", "grade", "confidence")
    complete = checkpointed(coverage.completeness(u, rel))
    state = r.spark.createDataFrame([("run", "ok", None, None)], "run string, cross_package_status string, cfn_found bigint, cfn_bound bigint")
    found = coverage.silence_flags(complete, state)
    none = r.spark.createDataFrame([], "run string, name string, unit_id string")
    queue = coverage.review_items(u, rel, r["ignored"].select(F.lit("run").alias("run"), "ref", "reason", "detail"), complete, found, none)
    return r.put(completeness=complete, silence_flags=found, review_queue=queue)


def threat(r: Run) -> DataFrame:
    """Units with an entry point and no control."""
    e = r["evidence"]
    return e.where("category = 'http-entry-point'").select("root", "file").distinct().join(e.where("category = 'security-control'").select("root", "file"), ["root", "file"], "left_anti")


def resilience(r: Run) -> DataFrame:
    """Units with evidence of resilience."""
    return evidence.resilience_of(r["evidence"].withColumnRenamed("match_source", "source"), ["root", "file"])


#: Modules by name, with the major contract version they know; one of another version is left out, and one that fails does not end the run.
MODULES: dict[str, tuple[str, Callable[[Run], DataFrame]]] = {"threat-signals": ("17", threat), "resilience-lens": ("17", resilience)}


def run_modules(r: Run, names: list[str], out: str) -> dict[str, str]:
    """What became of each module: written, unsupported, unknown, or the error it failed with."""
    major, fate = sinks.CONTRACT_VERSION.split(".")[0], {}
    for name in names:
        if name not in MODULES:
            fate[name] = "unknown"
        elif MODULES[name][0] != major:
            fate[name] = "unsupported"
        else:
            try:
                sinks.write_report(MODULES[name][1](r), f"{out}/modules/{name}")
                fate[name] = "written"
            except Exception as e:  # one module's fault must not cost the others their reports
                fate[name] = f"failed: {str(e)[:200]}"
    return fate


def run(spark: SparkSession, roots: list[str], out: str, prior: str | None = None, options: dict[str, str] | None = None, modules: list[str] | None = None) -> dict[str, str]:
    """A full scan of ``roots`` to ``out``: facts, ignored items, provenance, completeness, flags, queue, modules, and the merge with the facts of a ``prior`` run, if of the same major version."""
    r = Run(spark, [x.rstrip("/") for x in roots], options or {})
    for _, step in [*PASSES, ("report", report)]:
        r = step(r)
    sinks.write_run(out, r["units"], r["relationships"], r["ignored"], {"roots": ",".join(r.roots)})
    for name in ("completeness", "silence_flags", "review_queue"):
        sinks.write_report(r[name], f"{out}/{name}")
    if prior:
        merged = merge(spark, prior, r["units"], r["evidence"])
        sinks.write_report(merged, f"{out}/merge_report")
        runs.append_history(runs.history(merged, F.current_timestamp().cast("string")), f"{out}/history", "0")
    _signed(r["units"], r["evidence"]).write.mode("overwrite").parquet(f"{out}/signatures")
    return run_modules(r, list(MODULES) if modules is None else modules, out)


def _signed(units: DataFrame, found: DataFrame) -> DataFrame:
    sig = found.groupBy("root", "file").agg(runs.signature([F.col("match_source"), F.col("reference_name"), F.col("line").cast("string")]).alias("sig"))
    return units.join(sig, ["root", "file"], "left").select(F.concat_ws(":", "root", "unit_id").alias("id"), "status", "sig")


def merge(spark: SparkSession, prior: str, units: DataFrame, found: DataFrame) -> DataFrame:
    """U-03 against an earlier run's folder. Facts of another major contract version are refused."""
    version = spark.read.json(f"{prior}/run").first()["contract_version"]
    if version.split(".")[0] != sinks.CONTRACT_VERSION.split(".")[0]:
        raise ValueError(f"{prior} has contract version {version}")
    return runs.incremental_merge(spark.read.parquet(f"{prior}/signatures"), _signed(units, found))
