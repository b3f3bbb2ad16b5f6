"""What the operators of this subpackage share: reading, checkpoints, components."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space that separates words and is stripped from lines.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of text, and bytes of them, that go to a Python worker at once; bounds its memory.
ARROW_ROWS, ARROW_BYTES = 1000, 16 << 20
#: Bytes of words (estimated) that a task remembers at most.
REMEMBERED = 32 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def python_batches(spark: SparkSession) -> None:
    """Make Python workers ready: ship this package to them, and keep Arrow batches of whole texts small.

    The batch sizes (rows, and bytes, so that long texts come few at a time) are
    session settings that must still hold when a lazy result is computed; a
    user's smaller values stay.
    """
    context, package = spark.sparkContext, os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if not getattr(context, "kinframe_shipped", False):
        archive = os.path.join(tempfile.mkdtemp(prefix="kinframe-"), "kinframe.zip")
        with zipfile.ZipFile(archive, "w") as z:
            for folder, _, names in os.walk(package):
                for name in sorted(names):
                    if name.endswith(".py"):
                        path = os.path.join(folder, name)
                        z.write(path, os.path.relpath(path, os.path.dirname(package)))
        context.addPyFile(archive)
        context.kinframe_shipped = True
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > ARROW_ROWS:
        spark.conf.set(key, ARROW_ROWS)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < _bytes(spark.conf.get(key)) <= ARROW_BYTES:
        spark.conf.set(key, ARROW_BYTES)


def _bytes(size: str) -> int:
    """A size as Spark's settings have it ("8m", "64kb", "4096"), in bytes."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", size.lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit[0] if unit else "b")


class Remembered(dict):
    """What one task knows by word already, in two generations of so many (estimated) bytes together.

    Where the younger is full it becomes the older, which is forgotten but for the
    words asked for again. Freed with the task's partition.
    """

    def __init__(self, most: int = REMEMBERED):
        super().__init__()
        self.most, self.bytes, self.older = most, 0, {}

    def _rotate(self) -> None:
        if self.bytes > self.most // 2:
            self.older, self.bytes = dict(self), 0
            self.clear()

    def unknown(self, words) -> list:
        """Those of the distinct ``words`` that are new; all others can be looked up until the next call."""
        self._rotate()
        out = []
        for w in words:
            if w not in self:
                self.bytes += 240 + len(w)
                v = self.older.get(w)
                if v is None:
                    out.append(w)
                else:
                    self[w] = v
        return out

    def put(self, word: str, value):
        self._rotate()
        self.bytes += 240 + len(word)
        self[word] = value
        return value


def refuse_clash(df: DataFrame, keep, own) -> None:
    """An error where kept columns are missing, or named like those that an operator adds."""
    if clash := sorted({c.lower() for c in keep} & {c.lower() for c in own}):
        raise ValueError(f"kept columns are named like those added: {clash}")
    if missing := sorted(set(keep) - set(df.columns)):
        raise ValueError(f"no such columns: {missing}")


def widened(df: DataFrame, more: str) -> StructType:
    """The schema of ``df`` followed by the columns of a DDL string."""
    return StructType(df.schema.fields + StructType.fromDDL(more).fields)


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a folder of our own only where that is unset on one machine, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kinframe-checkpoint-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


#: Rows of a narrow table (a few numbers each) that a task takes well.
ROWS_A_TASK = 250_000


def fitted(df: DataFrame) -> DataFrame:
    """A narrow table that was cut before, in as many partitions as its rows need: many tiny ones cost files and tasks."""
    return df.coalesce(max(1, -(-df.count() // ROWS_A_TASK)))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else unchanged; ASCII strings take the fast built-in."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def hash128(*cols: Column) -> list[Column]:
    """Two independently seeded 64-bit hashes (the seed column must come first)."""
    return [F.xxhash64(F.lit(1), *cols), F.xxhash64(F.lit(2), *cols)]


#: Buckets of ids by which wide rows are pruned ahead of a shuffle; bounds that broadcast to some MB.
ID_BUCKETS = 1 << 20


def _wanted(df: DataFrame, ids: DataFrame, id_col: str) -> tuple[DataFrame, DataFrame]:
    number = F.pmod(F.xxhash64(id_col), F.lit(ID_BUCKETS)).cast("int")
    return df.withColumn("__bucket", number), F.broadcast(ids.select(number.alias("__bucket")).distinct())


def only(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` with one of ``ids``.

    Ids are hashed to a fixed number of buckets; rows in no wanted bucket are
    left out by a broadcast of bounded size, so the shuffle that follows carries
    little but the rows that are wanted.
    """
    rows, buckets = _wanted(df, ids, id_col)
    return rows.join(buckets, "__bucket", "left_semi").drop("__bucket").join(ids.select(id_col), id_col, "left_semi")


def without(df: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """Rows of ``df`` with none of ``ids``; rows whose bucket (as in :func:`only`) is free are not shuffled."""
    rows, buckets = _wanted(df, ids, id_col)
    free = rows.join(buckets, "__bucket", "left_anti").drop("__bucket")
    return free.union(rows.join(buckets, "__bucket", "left_semi").drop("__bucket").join(ids.select(id_col), id_col, "left_anti").select(*free.columns))


def attach(df: DataFrame, found: DataFrame, keys: list[Column], value: str, out: str, default: Column) -> DataFrame:
    """``df`` with ``value`` of the row of ``found`` (h1, h2, value; unique) whose keys are equal, else ``default``.

    ``keys`` are the two hashes of a row of ``df``. Rows in no bucket (as in
    :func:`only`) of ``found`` are not shuffled.
    """
    h1, h2 = (f"__{out}_h{i}" for i in (1, 2))
    rows, buckets = _wanted(df.withColumns({h1: keys[0], h2: keys[1]}), found.withColumnsRenamed({"h1": h1, "h2": h2}), h1)
    free = rows.join(buckets, "__bucket", "left_anti").select(*df.columns, default.alias(out))
    met = rows.join(buckets, "__bucket", "left_semi").join(found.select(F.col("h1").alias(h1), F.col("h2").alias(h2), F.col(value).alias(f"__{out}")), [h1, h2], "left")
    return free.union(met.select(*df.columns, F.coalesce(f"__{out}", default).alias(out)))


def _stars(pairs: DataFrame) -> bool:
    """Whether each node is either a leaf with one edge or a centre: nothing is left to do."""
    ends = pairs.select(F.col("a").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("centre")).union(pairs.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("centre").alias("centre")).where("leaf > 1 or (leaf = 1 and centre = 1)").isEmpty()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component): the smallest node reachable over the undirected ``edges`` (a, b).

    Alternates large-star and small-star rounds, which turn any graph into stars
    in logarithmically many rounds; each round is one pair of shuffles on the
    edges. Least neighbours come by partial aggregation and are cut to the
    checkpoint folder before they meet the edges, so that the join of a centre with
    very many edges is one that Spark splits. Only nodes with an edge are returned.
    Nothing but whether all are stars reaches the driver.
    """
    pairs = fitted(cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()))
    tasks = 2 * pairs.rdd.getNumPartitions()
    for _ in range(max_rounds):
        if _stars(pairs):
            break
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = cut(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")).coalesce(tasks))
        # large star: larger neighbours of a node move to the least of its neighbourhood
        large = cut(both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).coalesce(tasks))
        # small star: smaller neighbours of a node, and it, move to the least of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        star = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        pairs = cut(star.where("a <> b").distinct().coalesce(tasks))
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
