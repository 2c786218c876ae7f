"""Session helpers: table access, durable lineage cuts and sizing."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SMALL_ROWS = 10_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` below ``sf_dir`` (a file or a directory of parts)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that ``spark.checkpoint.dir`` names. Where none is set, a
    temporary folder serves sessions of one machine only; on a cluster that is an error, since a
    machine's own folder is lost with it."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not named and not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), "quire-checkpoints"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` once in the shared folder, so that later uses neither
    recompute Python work nor depend on executors that may be lost."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count shows that it has at most ``rows`` rows; else
    as it is, left to a shuffled join. Meant for tables that are cheap to count."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame, minimum: int | None = None) -> DataFrame:
    """Give a scan of few input splits enough partitions to use the cluster.

    A round-robin exchange is added only where the scan yields fewer partitions
    than there are task slots, i.e. on small inputs; large inputs are returned
    as they are, without a shuffle.
    """
    want = minimum or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(want) if df.rdd.getNumPartitions() < want else df
