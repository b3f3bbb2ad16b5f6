"""The nested change log, in batch and as a stream, and a snapshot that follows it by buckets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: One transaction with its list of changes; ``old`` and ``new`` are records of any class and stay JSON text.
TRANSACTION_DDL = (
    "id bigint, connection struct<user:struct<name:string>>, description string, first bigint, last bigint, undo boolean, timestamp double, "
    "changes array<struct<type:string,_class:string,handle:string,old:string,new:string>>"
)


def read_transactions(spark: SparkSession, path: str, stream: bool = False, files_a_batch: int | None = None) -> DataFrame:
    """Transactions from JSON lines, one schema for a batch and a stream; ``files_a_batch`` bounds what a stream takes at once."""
    reader = spark.readStream if stream else spark.read
    if stream and files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    return reader.schema(TRANSACTION_DDL).json(path)


def flatten_changes(transactions: DataFrame) -> DataFrame:
    """One row a change: (tx_id, pos, ts, user, undo, action, class, handle, old, new); ``pos`` is the place in the transaction.

    Works on a batch and on a stream. Transactions without a change have no row.
    """
    rows = transactions.select("id", "timestamp", F.col("connection.user.name").alias("user"), F.coalesce("undo", F.lit(False)).alias("undo"), F.posexplode("changes").alias("pos", "c"))
    return rows.select(
        F.col("id").alias("tx_id"), "pos", F.timestamp_micros(F.round(F.col("timestamp") * 1_000_000).cast("bigint")).alias("ts"), "user", "undo",
        F.col("c.type").alias("action"), F.col("c._class").alias("class"), F.col("c.handle").alias("handle"), F.col("c.old").alias("old"), F.col("c.new").alias("new"),
    )


_STATE = ("class", "handle", "tx_id", "pos", "action", "new")


def _newest(rows: DataFrame) -> DataFrame:
    """The last change of each record, by transaction and place; one row where a change came several times."""
    last = rows.groupBy("class", "handle").agg(F.max_by(F.struct("tx_id", "pos", "action", "new"), F.struct("tx_id", "pos")).alias("m"))
    return last.select("class", "handle", "m.*")


class BucketedSnapshot:
    """The newest state of every record in ``folder``, kept up to date by batches of changes.

    Records are dealt to ``buckets`` by hash. A batch rewrites the buckets it touches into a
    folder of its own and leaves the others where they are; last comes a manifest that
    says which folder holds each bucket, under the batch's number. A reader goes by the newest
    complete manifest, so a batch that dies half way leaves the snapshot as it was and writes
    the same folders again. A batch whose manifest is there has been applied and is
    skipped. Deleted records stay as a row without object, so that an older change of theirs
    that comes late stays without effect; readers do not see it. Folders that none of
    the last ``keep`` manifests names are removed.

    The driver holds one row for each bucket. All files are written and read by Spark.
    """

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 64, keep: int = 3):
        self.spark, self.folder, self.buckets, self.keep = spark, folder.rstrip("/"), buckets, keep

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _numbers(self, under: str, complete: bool = False) -> list[int]:
        """Batches with a folder below ``under``; only those that were written to the end if asked."""
        path, fs = self._fs()
        top = self.spark._jvm.org.apache.hadoop.fs.Path(path, under)
        if not fs.exists(top):
            return []
        found = [s.getPath() for s in fs.listStatus(top) if s.getPath().getName().startswith("batch=")]
        return sorted(int(p.getName()[6:]) for p in found if not complete or fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))

    def manifest(self) -> dict[int, int]:
        """Bucket -> batch whose folder holds it."""
        done = self._numbers("manifest", complete=True)
        if not done:
            return {}
        rows = self.spark.read.schema("bucket int, held int").parquet(f"{self.folder}/manifest/batch={done[-1]}").collect()
        return {r.bucket: r.held for r in rows}

    def _stored(self, held: dict[int, int]) -> DataFrame | None:
        paths = [f"{self.folder}/data/batch={b}/bucket={k}" for k, b in sorted(held.items())]
        schema = "class string, handle string, tx_id bigint, pos int, action string, new string"
        return self.spark.read.schema(schema).parquet(*paths) if paths else None

    def apply(self, changes: DataFrame, batch_id: int) -> list[int]:
        """Bring the snapshot up to date with a batch of flat changes; gives the buckets rewritten, none for a batch applied before."""
        if batch_id in self._numbers("manifest", complete=True) or (batch_id <= max(self._numbers("manifest", complete=True), default=-1)):
            return []
        held = self.manifest()
        bucket = F.pmod(F.xxhash64("class", "handle"), F.lit(self.buckets)).cast("int")
        staged = f"{self.folder}/staged-{uuid.uuid4().hex}"
        _newest(changes.select(*_STATE)).withColumn("bucket", bucket).write.partitionBy("bucket").parquet(staged)  # read twice below
        new = self.spark.read.schema("class string, handle string, tx_id bigint, pos int, action string, new string, bucket int").parquet(staged)
        touched = sorted(r.bucket for r in new.select("bucket").distinct().collect())
        if touched:
            old = self._stored({k: held[k] for k in touched if k in held})
            rows = new.select(*_STATE) if old is None else _newest(new.select(*_STATE).union(old.select(*_STATE)))
            rows = rows.withColumn("bucket", bucket).repartition(len(touched), "bucket")
            rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/data/batch={batch_id}")
        held |= {k: batch_id for k in touched}
        listed = self.spark.createDataFrame(sorted(held.items()), "bucket int, held int").coalesce(1)
        listed.write.mode("overwrite").parquet(f"{self.folder}/manifest/batch={batch_id}")
        self._remove(staged)
        self._clean()
        return touched

    def _remove(self, path: str) -> None:
        _, fs = self._fs()
        fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(path), True)

    def _clean(self) -> None:
        done = self._numbers("manifest", complete=True)
        for b in done[: -self.keep]:
            self._remove(f"{self.folder}/manifest/batch={b}")
        needed = {(k, b) for m in done[-self.keep :] for k, b in ((r.bucket, r.held) for r in self.spark.read.schema("bucket int, held int").parquet(f"{self.folder}/manifest/batch={m}").collect())}
        path, fs = self._fs()
        for b in self._numbers("data"):
            top = self.spark._jvm.org.apache.hadoop.fs.Path(path, f"data/batch={b}")
            for s in fs.listStatus(top):
                name = s.getPath().getName()
                if name.startswith("bucket=") and (int(name[7:]), b) not in needed and b <= done[-1]:
                    fs.delete(s.getPath(), True)

    def read(self) -> DataFrame:
        """(class, handle, tx_id, new) of the records that are there."""
        rows = self._stored(self.manifest())
        if rows is None:
            return self.spark.createDataFrame([], "class string, handle string, tx_id bigint, new string")
        return rows.where("action <> 'delete'").select("class", "handle", "tx_id", "new")


def follow(stream: DataFrame, snapshot: BucketedSnapshot, checkpoint: str):
    """The writer that keeps a snapshot up to date with a stream of flat changes; start it with a trigger of your choice."""
    return stream.writeStream.foreachBatch(lambda batch, batch_id: snapshot.apply(batch, batch_id) and None).option("checkpointLocation", checkpoint)
