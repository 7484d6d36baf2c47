"""Helpers that keep jobs sound on a cluster: checkpoint folder and size-checked broadcasts."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side made of a few scalars may be broadcast. At about 200 bytes a row this is 4 MB.
BROADCAST_ROWS = 20_000
#: Bytes of texts up to which a side may be broadcast.
BROADCAST_BYTES = 8_000_000


def use_checkpoint_dir(spark: SparkSession) -> None:
    """Point checkpoint() to the folder that the session names in spark.checkpoint.dir.

    The setting is only chosen here where it is unset and the master is local, as in tests; on a
    cluster without it an error is raised, since a folder of one machine would not survive its loss.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        sc.setCheckpointDir(named)
    elif sc.master.startswith("local[") or sc.master == "local":
        own = tempfile.mkdtemp(prefix="loomgrain-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    else:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared checkpoint folder: its lineage ends there."""
    use_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free(spark: SparkSession) -> None:
    """Have Spark remove shuffle files, and checkpoints where it is set to, that nothing refers to any more.

    It does so only when the driver's JVM happens to collect its garbage.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def broadcast_if(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS, size: int = 0) -> DataFrame:
    """df with a broadcast hint where its counted rows stay within limit, else unchanged (a shuffle join).

    size: the bytes of its texts, where it has any; no more than BROADCAST_BYTES are broadcast.
    """
    return F.broadcast(df) if rows <= limit and size <= BROADCAST_BYTES else df


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, for Python work that costs more than moving its input.

    A scan of few row groups has few tasks; its rows are then dealt out once. A scan of as many tasks as
    cores, which every large table has, isn't moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
