"""What a run says about itself: completeness, silence flags, and the queue of what people should look at."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Names of the flags and triggers, and beginnings of the details of ignored items.
S0, S1, S2, S3 = "S0-cross-package-backbone-incomplete", "S1-zero-service-touching-relationships", "S2-http-without-security-control", "S3-messaging-producer-unverified"
S5, S5_CFN, S6 = "S5-zero-service-units-with-store-present", "S5-cfn-routes-found-but-unbound", "S6-isolated-nodes"
LOW_COVERAGE, SINGLE_CANDIDATE, OUTBOUND = "low-architecture-coverage", "multi-hop-single-candidate-below-threshold", "unresolved-outbound-target"
HAND_ROLLED, LOW_CONFIDENCE, CONTRADICTING = "hand-rolled-resilience-candidate", "low-confidence-emitted-relationship", "contradicting-evidence-force-review"
MULTI_HOP_DETAIL, TIER_B_DETAIL, HTTP_DETAIL, ENV_DETAIL = 'unresolved-multi-hop: "', 'tier-b-single-candidate: "', "unresolved-http-target:", "unresolved-env-target:"
CONTRADICTION_DETAIL, RESILIENCE_DETAIL, CFN_DETAIL = "contradiction: ", "hand-rolled-resilience-candidate:", "unresolved-cfn-route:"
COVERAGE_THRESHOLD, CONFIDENCE_FLOOR = 0.5, 40


def completeness(units: DataFrame, relationships: DataFrame) -> DataFrame:
    """A-05: one row for each run of ``units`` (run, unit_id, kind, has_http, has_control, has_messaging) and ``relationships`` (run, from_id, to_id, grade).

    Columns: services, databases, topics, service_touching, http_without_control, messaging_unverified, isolated, services_outbound, outbound_coverage. The last is the share of services from which an architecture
    relationship starts; it is null, and services_outbound 0, where a run has no store, as then nothing is to be reached.
    """
    n = lambda c: F.count_if(c).cast("bigint")
    kind = F.col("kind")
    own = units.groupBy("run").agg(
        n(kind == "service").alias("services"), n(kind == "database").alias("databases"), n(kind == "topic").alias("topics"), n(F.col("has_http") & ~F.col("has_control")).alias("http_without_control"),
        n((kind == "topic") & F.col("has_messaging")).alias("messaging_unverified"),
    )
    services = units.where(kind == "service").select("run", "unit_id").distinct()
    end = lambda c, flag: services.select("run", F.col("unit_id").alias(c), F.lit(True).alias(flag))
    touching = relationships.join(end("from_id", "_a"), ["run", "from_id"], "left").join(end("to_id", "_b"), ["run", "to_id"], "left").groupBy("run").agg(n(F.coalesce("_a", "_b", F.lit(False))).alias("service_touching"))
    out = relationships.where("grade = 'architecture'").select("run", F.col("from_id").alias("unit_id")).distinct().join(services, ["run", "unit_id"]).groupBy("run").agg(F.count("*").alias("_out"))
    ends = relationships.select("run", F.explode(F.array("from_id", "to_id")).alias("unit_id")).distinct()
    lone = units.select("run", "unit_id").join(ends, ["run", "unit_id"], "left_anti").groupBy("run").agg(F.count("*").alias("isolated"))
    j = own.join(touching, "run", "left").join(out, "run", "left").join(lone, "run", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    stores = F.col("databases") + F.col("topics")
    reached = F.when(stores >= 1, zero("_out")).otherwise(F.lit(0)).cast("bigint")
    return j.select(
        "run", "services", "databases", "topics", zero("service_touching").alias("service_touching"), "http_without_control", "messaging_unverified", zero("isolated").alias("isolated"),
        reached.alias("services_outbound"), F.when((stores >= 1) & (F.col("services") > 0), reached / F.col("services")).alias("outbound_coverage"),
    )


def silence_flags(complete: DataFrame, runs: DataFrame) -> DataFrame:
    """A-06: (run, flag, n) for each flag that holds: ``complete`` as ``completeness`` gives it, ``runs`` (run, cross_package_status, cfn_found, cfn_bound).

    S0: the cross-root graph of the run is not ok. S1: services and databases, but no relationship touches a service. S2: HTTP units without a control. S3: topics known by fields and imports only.
    S5: stores, but no service. S5-cfn: routes in templates, none bound; a run that was given no templates has null there and no flag. S6: units that nothing touches. n is how many units, relationships or routes the flag speaks of.
    A run without units can have S0 and S5-cfn alone.
    """
    j = runs.join(complete, "run", "left")
    c = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("bigint")
    stores = c("databases") + c("topics")
    rules: list[tuple[str, Column, Column]] = [
        (S0, ~F.col("cross_package_status").eqNullSafe("ok"), F.lit(1)),
        (S1, (c("services") >= 1) & (c("databases") >= 1) & (c("service_touching") == 0), c("services")),
        (S2, c("http_without_control") > 0, c("http_without_control")),
        (S3, c("messaging_unverified") > 0, c("messaging_unverified")),
        (S5, (c("services") == 0) & (stores >= 1), stores),
        (S5_CFN, (c("cfn_found") > 0) & (F.col("cfn_bound") == 0), c("cfn_found")),
        (S6, c("isolated") > 0, c("isolated")),
    ]
    flags = F.array_compact(F.array(*(F.when(cond, F.struct(F.lit(name).alias("flag"), n.cast("bigint").alias("n"))) for name, cond, n in rules)))
    return j.select("run", F.explode(flags).alias("f")).select("run", "f.flag", "f.n")


def review_items(units: DataFrame, relationships: DataFrame, ignored: DataFrame, complete: DataFrame, flags: DataFrame, deployment_units: DataFrame) -> DataFrame:
    """U-08: (run, trigger, unit_id, unit_kind, confidence, detail): the union of all triggers.

    ``units`` (run, unit_id, file, kind, confidence, has_http, has_control, has_messaging), ``relationships`` (run, id, from_id, to_id, grade, confidence), ``ignored`` (run, ref, reason, detail), ``deployment_units`` (run, name, unit_id).
    Flags of a run name the units that they speak of: S1 its services and databases, each with the detail of its own unresolved bridge where there is one; S5 its stores; S2 and S3 the very units; S5-cfn has one row for the run, with up to five
    unbound routes and how many more there are. Where S1 does not hold and less than half of the services reach anything, those that do not are named. Single candidates, outbound targets, hand-rolled resilience,
    relationships below the floor and contradictions are always named. A relationship without confidence claims none and is not low.
    """
    of = lambda name: flags.where(F.col("flag") == name).select("run")
    row = lambda df, trigger, detail: df.select("run", F.lit(trigger).alias("trigger"), "unit_id", F.col("kind").alias("unit_kind"), "confidence", detail.alias("detail"))
    none = F.lit(None).cast("string")
    quoted = lambda prefix: F.substring_index(F.expr(f"substring(detail, {len(prefix) + 1})"), '"', 1)
    cross = ignored.where("reason = 'CROSS_DOMAIN_UNRESOLVED'")
    hops = cross.where(F.col("detail").startswith(MULTI_HOP_DETAIL)).select("run", quoted(MULTI_HOP_DETAIL).alias("unit_id"), "detail", "ref").groupBy("run", "unit_id").agg(F.min_by("detail", F.struct("ref", "detail")).alias("_hop"))
    kind = F.col("kind")
    parts = [row(units.where(kind.isin("service", "database")).join(of(S1), "run", "left_semi").join(hops, ["run", "unit_id"], "left"), S1, F.col("_hop"))]
    sparse = complete.where(F.col("outbound_coverage") < COVERAGE_THRESHOLD).select("run").join(of(S1), "run", "left_anti")
    reach = relationships.where("grade = 'architecture'").select("run", F.col("from_id").alias("unit_id")).distinct()
    parts.append(row(units.where(kind == "service").join(sparse, "run", "left_semi").join(reach, ["run", "unit_id"], "left_anti"), LOW_COVERAGE, none))
    parts.append(row(units.where(kind.isin("database", "topic")).join(of(S5), "run", "left_semi"), S5, none))
    routes = cross.unionByName(ignored.where("reason <> 'CROSS_DOMAIN_UNRESOLVED'")).where(F.col("detail").startswith(CFN_DETAIL)).select("run", "detail")
    five = routes.groupBy("run").agg(F.expr("array_sort(collect_list(detail)) as all_of"))
    text = F.concat(F.array_join(F.slice("all_of", 1, 5), " | "), F.when(F.size("all_of") > 5, F.concat(F.lit(" (+"), F.size("all_of") - 5, F.lit(" more)"))).otherwise(""))
    empty = [F.lit(None).cast("string").alias("unit_id"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("bigint").alias("confidence")]
    parts.append(row(of(S5_CFN).join(five, "run", "left").select("run", *empty, text.alias("detail")), S5_CFN, F.col("detail")))
    parts.append(row(units.where(F.col("has_http") & ~F.col("has_control")).join(of(S2), "run", "left_semi"), S2, none))
    parts.append(row(units.where((kind == "topic") & F.col("has_messaging")).join(of(S3), "run", "left_semi"), S3, none))
    known = units.groupBy("run", "unit_id").agg(F.min("kind").alias("kind"), F.min("confidence").alias("confidence"))
    by_file = units.groupBy("run", "file").agg(F.min("unit_id").alias("unit_id"))
    named = lambda df: df.join(known, ["run", "unit_id"], "left")
    parts.append(row(named(cross.where(F.col("detail").startswith(TIER_B_DETAIL)).select("run", quoted(TIER_B_DETAIL).alias("unit_id"), "detail")), SINGLE_CANDIDATE, F.col("detail")))
    file = F.regexp_replace("ref", r":\d+$", "").alias("file")
    http = cross.where(F.col("detail").startswith(HTTP_DETAIL)).select("run", file, "detail").join(by_file, ["run", "file"], "left")
    env = cross.where(F.col("detail").startswith(ENV_DETAIL)).select("run", F.regexp_extract("detail", '"([^"]+)"', 1).alias("name"), "detail").join(deployment_units.select("run", "name", "unit_id"), ["run", "name"], "left")
    parts += [row(named(df.select("run", "unit_id", "detail")), OUTBOUND, F.col("detail")) for df in (http, env)]
    rolled = ignored.where((F.col("reason") == "INSUFFICIENT_EVIDENCE") & F.col("detail").startswith(RESILIENCE_DETAIL)).select("run", file, "detail").join(by_file, ["run", "file"], "left")
    parts.append(row(named(rolled.select("run", "unit_id", "detail")), HAND_ROLLED, F.col("detail")))
    low = relationships.where((F.col("grade") == "architecture") & (F.col("confidence") < CONFIDENCE_FLOOR)).select("run", F.col("from_id").alias("unit_id"), F.col("id").alias("detail"))
    parts.append(row(named(low), LOW_CONFIDENCE, F.col("detail")))
    against = ignored.where((F.col("reason") == "AMBIGUOUS_BOUNDARY") & F.col("detail").startswith(CONTRADICTION_DETAIL)).select("run", F.col("ref").alias("unit_id"), "detail")
    parts.append(row(named(against), CONTRADICTING, F.col("detail")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
