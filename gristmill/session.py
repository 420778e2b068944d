"""Session helpers: table reading, checkpoints in the cluster's shared folder, id spelling."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that count as outer space of an id or a text value.
SPACES = " \t\n\r\f\v "


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named by ``spark.checkpoint.dir``. Where none is set, one machine (tests, a laptop) gets a temporary one; on a cluster that is an error, as its machines share no such folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where and not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="gristmill-checkpoint-"))


def checkpointed(df: DataFrame, keep_partitioning: bool = False) -> DataFrame:
    """``df`` written to the shared checkpoint folder: its lineage is cut and a lost executor costs no recomputation.

    With ``keep_partitioning`` Spark still knows afterwards by what ``df`` is partitioned, so that aggregates and joins on that need no exchange. An adaptive plan forgets it, hence this one plan is made without; it should therefore hold no join that needs adapting.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    if not keep_partitioning:
        return df.checkpoint(eager=True)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return df.checkpoint(eager=True)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


#: Most rows of a table that is broadcast; the rows so used are narrow.
SMALL_ROWS = 1_000_000


def is_small(df: DataFrame, rows: int = SMALL_ROWS) -> bool:
    """Whether ``df`` has at most ``rows`` rows. It is counted, so it should be checkpointed or cheap."""
    return df.limit(rows + 1).count() <= rows


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df``, to be broadcast if it has no more than ``rows`` rows; else Spark joins it as it is."""
    return F.broadcast(df) if is_small(df, rows) else df


def norm_id(c: Column | str) -> Column:
    """An id without outer spaces and in lower case; null where nothing is left, so that a blank id names nothing."""
    c = F.col(c) if isinstance(c, str) else c
    out = F.lower(F.trim(c, F.lit(SPACES)))
    return F.when(out != "", out)


def norm_text(c: Column | str) -> Column:
    """A text value without outer spaces, null as empty."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.trim(c, F.lit(SPACES)), F.lit(""))
