"""What people review: residuals, drafts, rankings, and exams against gold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REVIEW_WORTHY = ["AMBIGUOUS_BOUNDARY", "INSUFFICIENT_EVIDENCE"]


def review_worthy(ignored: DataFrame) -> DataFrame:
    """F-26: ignored items that are worth a second look."""
    return ignored.where(F.col("reason").isin(*REVIEW_WORTHY))


def lookup_with_default(rows: DataFrame, mapping: DataFrame, keys: list[str], value: str) -> DataFrame:
    """J-28: ``rows`` with the value of the mapping row that equals in all keys, else of the row whose keys are all null, which is the default. The mapping is a fixed catalogue."""
    exact = mapping.where(F.coalesce(*keys).isNotNull()).groupBy(*keys).agg(F.min(value).alias("_v"))
    default = mapping.where(F.coalesce(*keys).isNull()).agg(F.min(value).alias("_d"))
    return rows.join(F.broadcast(exact), keys, "left").join(F.broadcast(default), F.lit(True), "left").withColumn(value, F.coalesce("_v", "_d")).drop("_v", "_d")


def infer_protocol(rel: DataFrame, evidence: DataFrame, rule_protocol: Column) -> DataFrame:
    """J-29: the protocol of a relationship: its rule's, else that of its target's first evidence that has one, else of its source's. ``evidence`` (unit_id, ord, protocol)."""
    first = evidence.where("protocol is not null").groupBy("unit_id").agg(F.min_by("protocol", "ord").alias("p"))
    j = rel.join(first.select(F.col("unit_id").alias("to_id"), F.col("p").alias("_t")), "to_id", "left").join(first.select(F.col("unit_id").alias("from_id"), F.col("p").alias("_f")), "from_id", "left")
    return j.withColumn("protocol", F.coalesce(rule_protocol, "_t", "_f")).drop("_t", "_f")


def import_units(imports: DataFrame, classes: DataFrame, taken: DataFrame, kind: str, wired: DataFrame | None = None, owners: DataFrame | None = None, owned: list[str] | None = None) -> DataFrame:
    """J-10: units (root, file, name, library, start_line, end_line, kind, confidence) for the classes of files that import a library of ``kind``, unless the file is ``taken`` by a unit already.

    ``imports`` (root, file, library), ``classes`` (root, file, name, line, last_line). ``wired`` (root, file, name) are classes that only wire others and make no unit. A library of ``owned`` counts only for classes of ``owners``
    (root, file, name, library), which extend the base or have the field that using it takes. Of several libraries of a file the first by name is told. All of these come from exploded lines, whose size the planner does not know, so they are joined sorted and never broadcast. The confidence of an import is fixed at 20, and such units pass the floor (F-06).
    """
    hit = imports.groupBy("root", "file").agg(F.min("library").alias("library")).join(taken.select("root", "file").distinct().hint("merge"), ["root", "file"], "left_anti")
    j = classes.join(hit.hint("merge"), ["root", "file"])
    if wired is not None:
        j = j.join(wired.select("root", "file", "name").distinct().hint("merge"), ["root", "file", "name"], "left_anti")
    if owned:
        needs = F.col("library").isin(*owned)
        j = j.where(~needs).unionByName(j.where(needs).join(owners.select("root", "file", "name", "library").distinct().hint("merge"), ["root", "file", "name", "library"], "left_semi").select(j.columns))
    return j.groupBy("root", "file", "name", "library").agg(F.min("line").alias("start_line"), F.max(F.coalesce("last_line", "line")).alias("end_line")).withColumn("kind", F.lit(kind)).withColumn("confidence", F.lit(20))


def outbound_http(imports: DataFrame, is_client: Column, is_test: Column) -> DataFrame:
    """F-20: ignored items of files that import an HTTP client; what they call is not known, so there is never a relationship."""
    hit = imports.where(is_client)
    return hit.select("root", "file", F.concat(F.lit("unresolved-http-target:"), "file").alias("ref"), F.when(is_test, "TEST_CODE").otherwise("CROSS_DOMAIN_UNRESOLVED").alias("reason")).distinct()


def capability_warnings(fired: DataFrame, matrix: DataFrame) -> DataFrame:
    """S-27: (engine, mechanism, n) of mechanisms that fired though the matrix does not call them proven, or does not know them."""
    j = fired.groupBy("engine", "mechanism").agg(F.count("*").alias("n")).join(matrix, ["engine", "mechanism"], "left")
    return j.where(~F.col("state").eqNullSafe("proven")).select("engine", "mechanism", "n")


def carry_forward(prior: DataFrame, fresh: DataFrame) -> DataFrame:
    """J-30: (id, outcome) of ``fresh`` residuals that share a unit with a decided ``prior`` one: carried_forward if trigger and class are the same, else reconfirm; the rest is open.

    Both have (id, trigger, class, unit_id), one row for each unit.
    """
    p = prior.select("unit_id", F.col("trigger").alias("_t"), F.col("class").alias("_c")).distinct()
    j = fresh.join(p, "unit_id", "left").groupBy("id").agg(F.bool_or((F.col("_t") == F.col("trigger")) & (F.col("_c") == F.col("class"))).alias("same"), F.count("_t").alias("n"))
    return j.select("id", F.when(F.coalesce("same", F.lit(False)), "carried_forward").when(F.col("n") > 0, "reconfirm").otherwise("open").alias("outcome"))


def residual_age(residuals: DataFrame, packs: DataFrame, now: Column) -> DataFrame:
    """J-31: (id, age_days) since the oldest pack that shares a unit, in days with one decimal; null if none does."""
    j = residuals.withColumn("_now", now).join(packs.groupBy("unit_id").agg(F.min("generated_at").alias("generated_at")), "unit_id", "left").groupBy("id").agg(F.min("generated_at").alias("since"), F.max("_now").alias("_now"))
    return j.select("id", F.round((F.unix_micros(F.col("_now").cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp"))) / 86_400_000_000, 1).alias("age_days"))


def consequence(signals: DataFrame) -> DataFrame:
    """A-18: (id, score): the number of distinct risk signals."""
    return signals.groupBy("id").agg(F.count_distinct("signal").alias("score"))


def rank_and_cap(rows: DataFrame, keep: Column, most: int, order: list) -> tuple[DataFrame, DataFrame]:
    """W-07..W-11: (kept and the first ``most`` of the others in order, one row with the number left out). A cap is the feature here, and says what it hides."""
    ranked = rows.where(~keep).orderBy(*order).limit(most)
    rest = rows.where(~keep).agg(F.greatest(F.count("*") - most, F.lit(0)).alias("left_out"))
    return rows.where(keep).unionByName(ranked), rest


def top_options(rows: DataFrame, keys: list[str], order: list, most: int = 10) -> DataFrame:
    """W-10: the first ``most`` options of each key, each with the number that follows after them."""
    w = Window.partitionBy(*keys).orderBy(*order)
    counted = rows.groupBy(*keys).agg(F.greatest(F.count("*") - most, F.lit(0)).alias("overflow"))
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).join(counted, keys)


def validate_drafts(drafts: DataFrame, rules: list[tuple[str, Column]]) -> DataFrame:
    """U-05: (override_id, error) for each rule that a draft breaks; a rule is (error, condition under which it holds), and what is null breaks it."""
    errors = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules)))
    return drafts.select("override_id", F.explode(errors).alias("error")).distinct()


def bulk_replicate(anchors: DataFrame, siblings: DataFrame, keys: list[str]) -> DataFrame:
    """U-06: ``siblings`` with the answer of the anchor of the same keys; an anchor that changes more than a type is not copied, nor one of several that disagree."""
    a = anchors.where("override_type is null or override_type = 'type_change'").groupBy(*keys).agg(F.count_distinct("answer").alias("_n"), F.min("answer").alias("answer")).where("_n = 1").drop("_n")
    return siblings.join(a, keys)


def preview(merged: DataFrame, canonical: DataFrame, key: str) -> DataFrame:
    """U-07: what ``merged`` has and ``canonical`` has not, as drafts."""
    return merged.join(canonical.select(key).distinct(), key, "left_anti").withColumn("state", F.lit("draft"))


def leftovers(parts: list[DataFrame], claimed: DataFrame, ref: str) -> DataFrame:
    """U-09, W-11: the union of ``parts`` less what is claimed, each reference once, from the first part that has it."""
    out = None
    for i, p in enumerate(parts):
        one = p.withColumn("_part", F.lit(i))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    rest = [c for c in out.columns if c not in (ref, "_part")]
    once = out.groupBy(ref).agg(F.min(F.struct("_part", *rest)).alias("_r"))
    return once.select(ref, *(F.col("_r")[c].alias(c) for c in rest)).join(claimed.select(ref).distinct(), ref, "left_anti")


def residuals_by_trigger(residuals: DataFrame, decisions: DataFrame) -> DataFrame:
    """A-17: (trigger, tier, total, decided): residuals by what raised them, and how many have an active decision. ``residuals`` (id, trigger, tier), ``decisions`` (residual_id, status)."""
    done = decisions.where("status = 'active' and residual_id <> ''").select(F.col("residual_id").alias("id"), F.lit(True).alias("_d")).distinct()
    j = residuals.join(done, "id", "left").groupBy(F.coalesce("trigger", F.lit("<no trigger>")).alias("trigger"))
    return j.agg(F.min("tier").alias("tier"), F.count("*").alias("total"), F.count_if(F.coalesce("_d", F.lit(False))).alias("decided"))


def notebook_counts(nodes: DataFrame, relationships: DataFrame, residuals: DataFrame) -> DataFrame:
    """A-20: (section, key, n): nodes by type, relationships by grade, and residuals carried forward or open. What has no type or grade is unknown."""
    count = lambda df, section, key: df.groupBy(F.lit(section).alias("section"), key.alias("key")).agg(F.count("*").alias("n"))
    unknown = F.lit("unknown")
    state = F.when(F.col("status") == "carried_forward", "carried").otherwise("open")
    return count(nodes, "nodes", F.coalesce("node_type", unknown)).unionByName(count(relationships, "relationships", F.coalesce("grade", unknown))).unionByName(count(residuals, "residuals", state))


def scoreboard(scores: DataFrame) -> DataFrame:
    """A-21: one line for each package, by name in binary order; what was not scored is a dash. ``scores`` (package, tier, pass, node_precision, node_recall, interface_recall, relation_recall, violations)."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("-"))
    line = F.concat_ws(" | ", "package", told("tier"), told("pass"), F.concat_ws("/", told("node_precision"), told("node_recall")), told("interface_recall"), told("relation_recall"), F.coalesce(F.col("violations"), F.lit(0)).cast("string"))
    return scores.select("package", line.alias("line")).orderBy("package")


def session_cards(residuals: DataFrame, options: DataFrame) -> DataFrame:
    """K-07: (id, card): for each residual the text of its card: what it is about and its first ten options (W-10); one that is carried forward has a note and no options.

    ``residuals`` (id, tier, class, rationale, status), ``options`` (id, option_ord, label).
    """
    top = top_options(options, ["id"], ["option_ord"])
    texts = top.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(". ", F.col("rank").cast("string"), "label").alias("t")))), lambda x: x["t"]), "\n").alias("_o"), F.max("overflow").alias("_more"))
    more = F.when(F.col("_more") > 0, F.concat(F.lit("\n(+"), F.col("_more").cast("string"), F.lit(" more)"))).otherwise("")
    asked = F.concat(F.lit("### "), "id", F.lit(" ("), "tier", F.lit(", "), "class", F.lit(")\n\n"), "rationale", F.lit("\n\n"), F.coalesce(F.concat(F.col("_o"), more), F.lit("none of these")))
    carried = F.concat(F.lit("### "), "id", F.lit(" (carried forward)\n\n"), "rationale")
    return residuals.join(texts, "id", "left").select("id", F.when(F.col("status") == "carried_forward", carried).otherwise(asked).alias("card"))


def apply_report(log: DataFrame, by_trigger: DataFrame) -> DataFrame:
    """K-07: (line_ord, line): the report of an application: overrides by outcome, then decided residuals by trigger. ``log`` (override_id, outcome), ``by_trigger`` as ``residuals_by_trigger`` gives it."""
    outcomes = log.groupBy("outcome").agg(F.count("*").alias("n")).select(F.concat(F.lit("1"), "outcome").alias("line_ord"), F.format_string("- %s: %d", "outcome", "n").alias("line"))
    done = by_trigger.select(F.concat(F.lit("2"), "trigger").alias("line_ord"), F.format_string("  - [%s] %s: %d/%d", "tier", "trigger", "decided", "total").alias("line"))
    return outcomes.unionByName(done)


def control_map(controls: DataFrame, files: DataFrame) -> DataFrame:
    """K-08: (url, path): where each control's requirement lies; a control without a file is an error, since a document that names it could not be checked. ``controls`` (control_id, url), ``files`` (control_id, path)."""
    j = controls.join(files.groupBy("control_id").agg(F.min("path").alias("path")), "control_id", "left")
    return j.select("url", F.coalesce("path", F.raise_error(F.concat(F.lit("no requirement file for control "), "control_id")).cast("string")).alias("path")).distinct()


def missing_topology(gold: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """A-16: the pairs of ``gold`` that ``found`` has too few of, as multisets: (keys, need, have)."""
    n = gold.groupBy(*keys).agg(F.count("*").alias("need"))
    h = found.groupBy(*keys).agg(F.count("*").alias("have"))
    return n.join(h, keys, "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < need")


def exam_guard(gold_multi_root: Column, n_roots: Column) -> Column:
    """F-24: an exam is scored only if gold and scan agree on one root or several."""
    return F.when(gold_multi_root.isNull() | n_roots.isNull(), "not-applicable").when(gold_multi_root != (n_roots > 1), "refused").otherwise("scored")
