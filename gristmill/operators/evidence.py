"""From facts to scored units: rule matching, evidence rollup, bands, kinds, floors, gates and first-wins choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.functions.text import is_test_path, stem
from gristmill.operators.catalog import FLOOR, HIGH, MEDIUM, signal_rules
from gristmill.operators.scan import segmented_last


def split_test_paths(df: DataFrame, path: str = "file") -> tuple[DataFrame, DataFrame]:
    """F-01: (rows of product code, rows of test code); together they are the input."""
    flagged = df.withColumn("_test", is_test_path(F.col(path)))
    return flagged.where(~F.col("_test")).drop("_test"), flagged.where("_test").drop("_test")


def match_signals(facts: DataFrame, signal: str = "reference_name", source: str = "match_source", language: str = "language") -> DataFrame:
    """J-01, F-02, F-03: ``facts`` with rule_id, category and weight of the first rule that fits, null where none does.

    A rule fits if its signal stands in the name between word boundaries, without regard to case, its source is that of the fact, and its language too where the fact has one.
    Only the distinct (name, source, language) meet the rules, which are few, so the regexes run once for each name.
    """
    keys = facts.select(F.col(signal).alias("_s"), F.col(source).alias("_m"), F.col(language).alias("_l")).distinct()
    rules = F.broadcast(signal_rules(facts.sparkSession))
    hit = keys.join(rules, (F.col("_m") == F.col("rule_source")) & (F.col("_l").isNull() | (F.col("_l") == F.col("rule_language"))) & F.expr("_s rlike pattern"))
    best = hit.groupBy("_s", "_m", "_l").agg(F.min(F.struct("rule_ord", "rule_id", "category", "weight")).alias("r")).select("_s", "_m", "_l", "r.rule_id", "r.category", "r.weight")
    on = (facts[signal] == best["_s"]) & (facts[source] == best["_m"]) & facts[language].eqNullSafe(best["_l"])
    return facts.join(best, on, "left").drop("_s", "_m", "_l")


def band(confidence: Column) -> Column:
    """F-07: high from 70, medium from 40, else low."""
    return F.when(confidence >= HIGH, "high").when(confidence >= MEDIUM, "medium").otherwise("low")


def kind_of(has_entry: Column, has_store: Column, has_topic: Column) -> Column:
    """F-08: entry points beat persistence, which beats messaging; anything else is a service."""
    return F.when(has_entry, "service").when(has_store, "database").when(has_topic, "topic").otherwise("service")


def rollup(matched: DataFrame, unit: list[str], line: str = "line", class_name: Column | None = None, path: str | None = None) -> DataFrame:
    """A-01, A-02, F-07..F-09: one row for each unit with its evidence added up, at most 100."""
    has = lambda *cs: F.bool_or(F.col("category").isin(*cs))
    aggs = [F.count("*").alias("n_evidence"), F.least(F.lit(100), F.sum("weight")).cast("bigint").alias("confidence"), F.min(line).cast("bigint").alias("start_line"), F.max(line).cast("bigint").alias("end_line")]
    aggs += [has("http-entry-point", "serverless-entry-point").alias("_e"), has("persistence").alias("_p"), has("messaging").alias("_t")]
    if class_name is not None:
        aggs += [F.count_distinct(class_name).alias("_nc"), F.min(class_name).alias("_c")]
    out = matched.where(F.col("rule_id").isNotNull()).groupBy(*unit).agg(*aggs)
    out = out.withColumn("band", band(F.col("confidence"))).withColumn("kind", kind_of(F.col("_e"), F.col("_p"), F.col("_t")))
    if class_name is not None:
        out = out.withColumn("name", F.when(F.col("_nc") == 1, F.col("_c")).otherwise(stem(F.col(path))))
    return out.drop("_e", "_p", "_t", "_nc", "_c")


def floor_split(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """F-05: (units at or above the confidence floor, ignored items of the others)."""
    low = units.where(F.col("confidence") < FLOOR).withColumn("reason", F.lit("INSUFFICIENT_EVIDENCE"))
    return units.where(F.col("confidence") >= FLOOR), low


def exactly_one(df: DataFrame, keys: list[str], candidate: str) -> DataFrame:
    """J-07: (keys, n_candidates, candidate, outcome); the candidate only where exactly one distinct value is there.

    outcome is resolved, zero or ambiguous. Null candidates count as none, so a key with nulls alone comes out as zero.
    """
    g = df.groupBy(*keys).agg(F.count_distinct(candidate).alias("n_candidates"), F.min(candidate).alias("_c"))
    one = F.col("n_candidates") == 1
    return g.select(*keys, "n_candidates", F.when(one, F.col("_c")).alias(candidate), F.when(one, "resolved").when(F.col("n_candidates") == 0, "zero").otherwise("ambiguous").alias("outcome"))


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """W-03: the row with the least ``order`` of each key, by an aggregate that combines before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    m = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return m.select(*keys, *(F.col("_r")[c].alias(c) for c in rest))


def best_tier(df: DataFrame, keys: list[str], precedence: Column) -> DataFrame:
    """W-02: all rows of each key at its least precedence."""
    tier = df.withColumn("_p", precedence)
    least = tier.groupBy(*keys).agg(F.min("_p").alias("_p"))
    return tier.join(least, [*keys, "_p"], "left_semi").drop("_p")


def nearest_preceding(df: DataFrame, keys: list[str], order: list[str], is_anchor: Column, value: Column, out: str) -> DataFrame:
    """J-03, W-01: for each row ``value`` of the last anchor row before it within its key; null where none is."""
    return segmented_last(df, keys, order, F.when(is_anchor, value), out)


def clusters(unmatched: DataFrame, signal: str, order: list[str], sample: Column, samples: int = 5, top: int = 100) -> DataFrame:
    """A-07: unmatched signals with their number and first samples; the ``top`` most frequent, which is the report's feature.

    Samples are taken by an aggregate of bounded size for each task first, so a frequent signal is not gathered.
    """
    w = Window.partitionBy("_part", signal).orderBy(*order)
    some = unmatched.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(64))).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= samples)
    firsts = some.withColumn("_m", F.row_number().over(Window.partitionBy(signal).orderBy(*order))).where(F.col("_m") <= samples)
    texts = firsts.groupBy(signal).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_m", sample.alias("_x")))), lambda s: s["_x"]), ",").alias("samples"))
    counts = unmatched.groupBy(signal).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), signal).limit(top).join(texts, signal)


def java_imports(lines: DataFrame) -> DataFrame:
    """S-22: (root, file, line, qualified, bare) of each import line."""
    q = F.regexp_extract("text", r"^\s*import\s+(?:static\s+)?([A-Za-z_][\w.]*)\s*;", 1)
    return lines.select("root", "file", "line", q.alias("qualified")).where("qualified <> ''").withColumn("bare", F.regexp_extract("qualified", r"([^.]+)$", 1)).distinct()


def smoke_counts(lines: DataFrame) -> DataFrame:
    """S-21: (root, n_hits) of text that looks like a route, to hold against the routes found."""
    # What routes look like in the text of Python and TypeScript files.
    pattern = r"@app\.route\(|@router\.(?:get|post|put|patch|delete)\(|@Controller\(|@(?:Get|Post|Put|Patch|Delete)\("
    return lines.where(F.col("file").rlike(r"\.(?:py|ts)$")).groupBy("root").agg(F.sum(F.regexp_count("text", F.lit(pattern))).cast("bigint").alias("n_hits"))


def suppress_route_lines(unmatched: DataFrame, routes: DataFrame) -> DataFrame:
    """J-02: ``unmatched`` facts less the decorators of methods on a line where a native route begins, as the route explains them. ``routes`` (root, file, start_line)."""
    lines = routes.select("root", "file", F.col("start_line").alias("line"), F.lit("method").alias("from_node_kind"), F.lit("decorator").alias("match_source")).distinct()
    return unmatched.join(lines, ["root", "file", "line", "from_node_kind", "match_source"], "left_anti")


def match_controls(facts: DataFrame, controls: DataFrame, signal: str = "reference_name", language: str = "language") -> DataFrame:
    """F-04: ``facts`` with the control they are evidence of, null where none is: of the controls whose signal is found, the first of the fact's language, else the first of all.

    A control's signal is a pattern of its own, put between word boundaries as a whole, so of a|b|c only a and c are bounded, on one side. ``controls`` (control_ord, control_id, control_language, control_signal) is a fixed catalogue;
    the distinct (signal, language) meet it, not the facts.
    """
    keys = facts.select(F.col(signal).alias("_s"), F.col(language).alias("_l")).distinct()
    hit = keys.join(F.broadcast(controls), F.expr("_s rlike concat('(?i)\\\\b', control_signal, '\\\\b')"))
    other = ~F.coalesce(F.lower("_l") == F.lower("control_language"), F.lit(False))
    best = hit.groupBy("_s", "_l").agg(F.min_by("control_id", F.struct(other, "control_ord")).alias("control_id"))
    return facts.join(best, (facts[signal] == best["_s"]) & facts[language].eqNullSafe(best["_l"]), "left").drop("_s", "_l")


# Fixed value: calls that may be a retry written by hand.
RESILIENCE_CALLS = ["Thread.sleep"]


def resilience_candidates(calls: DataFrame, vocabulary: list[str] | None = None) -> DataFrame:
    """F-11: (root, ref, reason, detail): calls of the exact vocabulary are ignored items, never units; what they are for cannot be told from the call."""
    ref = F.concat_ws(":", "file", "line")
    detail = F.concat(F.lit('hand-rolled-resilience-candidate: calls "'), "reference_name", F.lit('" at '), ref)
    return calls.where((F.col("match_source") == "call") & F.col("reference_name").isin(*(vocabulary or RESILIENCE_CALLS))).select("root", ref.alias("ref"), F.lit("INSUFFICIENT_EVIDENCE").alias("reason"), detail.alias("detail")).distinct()


def with_exempt(kept: DataFrame, exempt: DataFrame) -> DataFrame:
    """F-06: units above the floor together with those that need not reach it: units found by imports, and those that manifests or bindings introduce."""
    return kept.unionByName(exempt, allowMissingColumns=True)


def append_evidence(units: DataFrame, evidence: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J-12: (evidence, rest): ``more`` evidence of units that exist goes to them, by id; their kind and confidence stay as they are. What has no unit is the rest."""
    known = units.select("root", "unit_id").distinct()
    return evidence.unionByName(more.join(known, ["root", "unit_id"], "left_semi"), allowMissingColumns=True), more.join(known, ["root", "unit_id"], "left_anti")


def resilience_of(evidence: DataFrame, keys: list[str]) -> DataFrame:
    """F-13: (keys, has_retry, has_timeout) of the units with evidence of resilience: retries are decorators, timeouts come from configuration. ``evidence`` has category and source."""
    r = evidence.where("category = 'resilience'")
    return r.groupBy(*keys).agg(F.coalesce(F.bool_or(F.col("source") == "decorator"), F.lit(False)).alias("has_retry"), F.coalesce(F.bool_or(F.col("source").isin("spring-config", "structured-config")), F.lit(False)).alias("has_timeout"))


# Decorators that give a class a path, and verbs of methods, alone or as GetMapping and the like.
CLASS_PATHS = ["Controller", "Path", "RequestMapping"]
VERB = r"^(?i:(get|post|put|patch|delete))(?:Mapping)?$"


def compose_routes(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J-03: (routes, rest): every verb of a method composed with the method's own path and the nearest class path before it in the file; (root, file, line, ord, verb, route).

    The method's path is the argument of its verb, else that of a Path on the same method. A verb without class path before it makes no route. ``facts`` are decorators (root, file, line, ord, from_node_kind, from_node_id, from_node_name, reference_name, argument); the rest are those
    that no route consumed.
    """
    verb = F.upper(F.regexp_extract("reference_name", VERB, 1))
    is_class, on_method = F.col("from_node_kind") == "class", F.col("from_node_kind") == "method"
    seen = nearest_preceding(facts, ["root", "file"], ["line", "ord"], is_class & F.col("reference_name").isin(*CLASS_PATHS) & F.col("argument").isNotNull(), F.col("argument"), "base")
    member = ["root", "file", "from_node_id", "from_node_name"]
    own = facts.where(on_method & (F.col("reference_name") == "Path") & F.col("argument").isNotNull()).groupBy(*member).agg(F.min_by("argument", F.struct("line", "ord")).alias("_own"))
    verbs = seen.where(on_method & (verb != "") & F.col("base").isNotNull()).withColumn("verb", verb).join(own, member, "left")
    bare = lambda c: F.trim(c, F.lit("/"))
    path = bare(F.coalesce("argument", "_own"))
    route = F.concat(F.col("verb"), F.lit(" /"), F.concat_ws("/", F.nullif(bare(F.col("base")), F.lit("")), F.nullif(path, F.lit(""))))
    routes = verbs.select("root", "file", "line", "ord", "verb", route.alias("route"))
    return routes, facts.join(routes.select("root", "file", "line", "ord").distinct(), ["root", "file", "line", "ord"], "left_anti")
