"""Cutting lineage in iterative operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a narrow table that a task takes well.
ROWS_A_TASK = 250_000


def _folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of our own only where that is unset on one machine, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kinframe-checkpoint-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the session's checkpoint folder and go on from there."""
    _folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fitted(df: DataFrame) -> DataFrame:
    """A narrow table that was cut before, in as many partitions as its rows need."""
    return df.coalesce(max(1, min(df.rdd.getNumPartitions(), max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // ROWS_A_TASK)))))


#: Rows of a narrow table that are sent to every task rather than shuffled with what they meet.
FEW = 50_000


def beside(df: DataFrame, rows: int) -> DataFrame:
    """A narrow table of so many rows as one side of a join: broadcast if they are few, else never, whatever Spark guesses their size to be."""
    return F.broadcast(df) if rows <= FEW else df.hint("merge")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder, below the checkpoint folder, for tables that all executors must see."""
    return f"{_folder(spark)}/{name}-{uuid.uuid4().hex}"
