"""Change history in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LOG_DDL = "tx_id bigint, ts timestamp, user bigint, undo boolean, action string, class string, handle string, old string, new string"


def history(log: DataFrame, after: str | None = None, before: str | None = None, newest_first: bool = True, payloads: bool = False) -> DataFrame:
    """Log rows between two times, ordered by transaction; old and new objects on request only."""
    if after:
        log = log.where(F.col("ts") > F.lit(after).cast("timestamp"))
    if before:
        log = log.where(F.col("ts") < F.lit(before).cast("timestamp"))
    log = log if payloads else log.drop("old", "new")
    return log.orderBy(F.desc("tx_id") if newest_first else F.asc("tx_id"), "class", "handle")


def transaction(log: DataFrame, tx_id: int) -> DataFrame:
    return log.where(F.col("tx_id") == tx_id)


def summaries(log: DataFrame, first: int = 3) -> DataFrame:
    """(tx_id, changes, first, more): per transaction the count, the first objects as class:handle, and how many more.

    Objects are ranked within 64 hash parts of a transaction, so that a large one neither fills one task nor one buffer.
    """
    rows = log.select("tx_id", F.concat_ws(":", "class", "handle").alias("named"), F.pmod(F.xxhash64("class", "handle", "ts"), F.lit(64)).alias("part"))
    ranked = rows.withColumn("n", F.row_number().over(Window.partitionBy("tx_id", "part").orderBy("named")))
    out = ranked.groupBy("tx_id").agg(F.count("*").alias("changes"), F.slice(F.array_sort(F.collect_list(F.when(F.col("n") <= first, F.col("named")))), 1, first).alias("first"))
    return out.withColumn("more", F.greatest(F.col("changes") - first, F.lit(0)))


def read_changes(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """The log as JSON lines; ``stream`` reads the same files as they come."""
    reader = spark.readStream if stream else spark.read
    return reader.schema(LOG_DDL).json(path)


def change_windows(log: DataFrame, width: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Changes per window, user and class; the same code for a batch and a stream, where rows later than ``late`` are dropped."""
    rows = log.withWatermark("ts", late) if log.isStreaming else log
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    counts = rows.groupBy(window, "user", "class").agg(F.count("*").alias("changes"), F.count_if(F.col("action") == "delete").alias("deletes"))
    return counts.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "user", "class", "changes", "deletes")


def change_sessions(log: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of a user's changes, ended by ``gap`` of rest."""
    rows = log.withWatermark("ts", late) if log.isStreaming else log
    out = rows.groupBy(F.session_window("ts", gap), "user").agg(F.count("*").alias("changes"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "user", "changes")


def latest(log: DataFrame) -> DataFrame:
    """(handle, class, tx_id, new): the newest object of each handle; deleted ones are gone."""
    last = log.groupBy("handle", "class").agg(F.max(F.struct("tx_id", "action", "new")).alias("m"))
    return last.where("m.action <> 'delete'").select("handle", "class", F.col("m.tx_id").alias("tx_id"), F.col("m.new").alias("new"))


def maintain_snapshot(stream: DataFrame, folder: str, checkpoint: str):
    """Keep the newest change of each handle in ``folder``: one new version per batch, named by the batch.

    A replayed batch writes the same version again: rows are reduced by
    transaction id, so applying a change twice changes nothing.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = batch
        if batch_id > 0:
            rows = rows.unionByName(spark.read.parquet(f"{folder}/version={batch_id - 1}"))
        newest = rows.groupBy("handle", "class").agg(F.max_by(F.struct(*(c for c in rows.columns if c not in ("handle", "class"))), "tx_id").alias("m"))
        newest.select("handle", "class", "m.*").select(*batch.columns).write.mode("overwrite").parquet(f"{folder}/version={batch_id}")

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
