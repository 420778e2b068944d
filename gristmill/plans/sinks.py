"""What a run leaves behind: tables, documents, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTRACT_VERSION = "17.0.0"


def write_facts(tables: dict[str, DataFrame], path: str) -> None:
    """K-01, K-06: one Parquet table for each frame, and a manifest row with the contract version."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    any_df = next(iter(tables.values()))
    any_df.sparkSession.createDataFrame([(CONTRACT_VERSION, ",".join(sorted(tables)))], "contract_version string, tables string").coalesce(1).write.mode("overwrite").json(f"{path}/run")


def architecture_json(nodes: DataFrame, relationships: DataFrame, by: str = "root") -> DataFrame:
    """K-01: (by, doc): one JSON document for each ``by``, put together by the executors. A document is what people read, so it is one value."""
    n = nodes.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col("unit_id").alias("unique-id"), F.col("node_type").alias("node-type"), "name"))).alias("nodes"))
    r = relationships.groupBy(by).agg(F.array_sort(F.collect_list(F.struct(F.col("id").alias("unique-id"), "from_id", "to_id", "kind"))).alias("relationships"))
    return n.join(r, by, "left").select(by, F.to_json(F.struct("nodes", "relationships")).alias("doc"))


def write_report(df: DataFrame, path: str) -> None:
    """K-02: a report with all its rows, as JSON lines in a folder, written by the executors."""
    df.write.mode("overwrite").json(path)


def module_report(findings: DataFrame, module: str, fitness: dict[str, str]) -> DataFrame:
    """K-04: (module, fitness, finding): a module's findings, each as JSON, with what the module declares about how well it was tried."""
    declared = F.to_json(F.struct(*(F.lit(v).alias(k) for k, v in sorted(fitness.items()))))
    return findings.select(F.lit(module).alias("module"), declared.alias("fitness"), F.to_json(F.struct(*findings.columns)).alias("finding"))


def write_run(path: str, units: DataFrame, relationships: DataFrame, ignored: DataFrame, provenance: dict[str, str]) -> None:
    """K-01: facts, ignored items and the provenance document of a run: contract version, roots, time and whatever else ``provenance`` says."""
    write_facts({"units": units, "relationships": relationships, "ignored_items": ignored}, path)
    spark = units.sparkSession
    spark.createDataFrame([(json.dumps({"contractVersion": CONTRACT_VERSION} | provenance, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/provenance")


def notebook(title: str, sections: dict[str, DataFrame], most: int = 50) -> str:
    """K-05: a Markdown notebook of small aggregates; each section shows ``most`` rows and says what it leaves out."""
    parts = [f"# {title}"]
    for name, df in sections.items():
        rows = df.limit(most + 1).collect()
        parts += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        parts += ["| " + " | ".join(str(v) for v in r) + " |" for r in rows[:most]]
        if len(rows) > most:
            parts.append(f"\n({df.count() - most} more)")
    return "\n".join(parts) + "\n"


def notebook_lines(sections: dict[str, DataFrame]) -> DataFrame:
    """K-05: (section, line_ord, line): the sections of a notebook as Markdown lines, heads first and rows after them, with all rows and without the driver."""
    out = None
    for name, df in sections.items():
        head = [(name, "0", f"## {name}"), (name, "1", "| " + " | ".join(df.columns) + " |"), (name, "2", "|" + "---|" * len(df.columns))]
        cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)), F.lit(" |"))
        part = df.sparkSession.createDataFrame(head, "section string, line_ord string, line string").unionByName(df.select(F.lit(name).alias("section"), F.concat(F.lit("3"), cells).alias("line_ord"), cells.alias("line")))
        out = part if out is None else out.unionByName(part)
    return out
