"""Lineage cutting and size-checked choices shared by the operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder checkpoints go to.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without one gets a
    temporary folder; elsewhere a missing setting is an error, since executors share no local disk.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
            folder = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """`df` computed once into the checkpoint folder, with its lineage cut.

    Iterative operators call this once per round, so a lost executor costs a re-read of the last
    round and never a replay of the loop.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """`df` computed once into a parquet table in the checkpoint folder.

    For a wide or large result that several plans read: it is columnar, so each reads only its
    columns, and its statistics let Spark choose joins by real sizes.
    """
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    return len(df.take(1)) == 0
