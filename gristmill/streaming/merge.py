"""Runs as a stream: the facts of a run, however many files they come in, are merged into the last state, with a history of every run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gristmill.operators.runs import append_history, history, incremental_merge, signature

#: A fact says of which run it is, the how-manieth that is (from 0, without gaps), and how many facts the run has in all.
FACTS = "run_id string, run_no bigint, n_facts bigint, id string, status string, evidence string"
STATE = "id string, status string, sig string"


def _runs_done(spark: SparkSession, path: str) -> int:
    """How many runs have a complete state: the greatest number of a folder that holds Spark's mark of success, and one more. A missing folder is none, any other fault is raised."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(f"{path}/state")
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(root):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    done = [int(n.removeprefix("run=")) for n in names if n.startswith("run=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/state/{n}/_SUCCESS"))]
    return max(done, default=-1) + 1


def _merge_run(spark: SparkSession, facts: DataFrame, run_no: int, path: str) -> None:
    """Merge one whole run. Its history and its state have folders of their own, and the state comes last, so a run that is merged again after a failure gives the same."""
    prior = spark.read.schema(STATE).parquet(f"{path}/state/run={run_no - 1}") if run_no else spark.createDataFrame([], STATE)
    fresh = facts.groupBy("id").agg(F.max("status").alias("status"), signature([F.col("evidence")]).alias("sig"))
    merged = incremental_merge(prior, fresh)
    append_history(history(merged, F.lit(str(run_no))), f"{path}/history", str(run_no))
    alive = merged.where("outcome <> 'disappeared'").select("id", F.col("to_status").alias("status")).join(fresh.select("id", "sig"), "id")
    alive.write.mode("overwrite").parquet(f"{path}/state/run={run_no}")


def merge_batch(facts: DataFrame, n: int, path: str) -> None:
    """Keep a batch, then merge every run, in order, of which all facts have come. A batch that comes again overwrites itself and finds its runs merged; facts that are delivered twice count once."""
    spark = facts.sparkSession
    facts.write.mode("overwrite").parquet(f"{path}/facts/batch={n}")
    done = _runs_done(spark, path)
    held = spark.read.schema(FACTS).parquet(f"{path}/facts/batch=*").where(F.col("run_no") >= done).distinct()
    come = held.groupBy("run_no").agg(F.count("*").alias("n"), F.max("n_facts").alias("all")).where("n >= all").select("run_no")
    ready = {r.run_no for r in come.collect()}  # runs that wait, one row each
    while done in ready:
        _merge_run(spark, held.where(F.col("run_no") == done), done, path)
        done += 1


def merge_stream(spark: SparkSession, source: str, path: str) -> StreamingQuery:
    """U-03 over a folder of fact files as they come. A run may come in many files and batches, and files of several runs in one; each run is merged once it is whole and those before it are."""
    stream = spark.readStream.schema(FACTS).parquet(source)
    return stream.writeStream.foreachBatch(lambda df, n: merge_batch(df, n, path)).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
