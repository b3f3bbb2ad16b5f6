"""Operator 11: hard negatives by exact integer products of anchor and candidate tiles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinframe.llm.common import cut, python_batches, read


def strassen(a: np.ndarray, b: np.ndarray, least: int = 16) -> np.ndarray:
    """``a @ b`` of int64 matrices by seven half-size products; odd sides are padded with zeros.

    All steps are additions and products of 64-bit integers, which wrap around alike
    on every path, so the result is exact wherever it fits 64 bits, whatever the
    sums on the way. Down to ``least`` on the shortest side, then the plain product.
    """
    m, k, n = *a.shape, b.shape[1]
    if min(m, k, n) <= least:
        return a @ b
    if m % 2 or k % 2 or n % 2:
        a, b = np.pad(a, ((0, m % 2), (0, k % 2))), np.pad(b, ((0, k % 2), (0, n % 2)))
    x, y, z = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:x, :y], a[:x, y:], a[x:, :y], a[x:, y:]
    b11, b12, b21, b22 = b[:y, :z], b[:y, z:], b[y:, :z], b[y:, z:]
    out = np.zeros((2 * x, 2 * z), np.int64)
    c11, c12, c21, c22 = out[:x, :z], out[:x, z:], out[x:, :z], out[x:, z:]
    for left, right, plus, minus in (
        (a11 + a22, b11 + b22, (c11, c22), ()),
        (a21 + a22, b11, (c21,), (c22,)),
        (a11, b12 - b22, (c12, c22), ()),
        (a22, b21 - b11, (c11, c21), ()),
        (a11 + a12, b22, (c12,), (c11,)),
        (a21 - a11, b11 + b12, (c22,), ()),
        (a12 - a22, b21 + b22, (c11,), ()),
    ):
        p = strassen(left, right, least)
        for c in plus:
            c += p
        for c in minus:
            c -= p
    return out[:m, :n]


class Heap:
    """The best ``most`` (score, id) pairs: higher scores first, ties by smaller id. Any two merge into one."""

    def __init__(self, most: int):
        self.most, self.rows = most, []

    def merge(self, scores, ids) -> None:
        self.rows = sorted([*self.rows, *zip((-int(s) for s in scores), map(int, ids))])[: self.most]

    def least(self) -> int | None:
        """No score below it gets in; None while there is room."""
        return -self.rows[-1][0] if len(self.rows) == self.most else None

    def pairs(self) -> list[tuple[int, int]]:
        return [(-s, i) for s, i in self.rows]


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _tiles(anchors: pa.Table, candidates: pa.Table, chunk: int):
    """(scores, labels, ids) of a chunk of candidates at a time, ordered by id, against all anchors of the cell."""
    a = _matrix(anchors.column("q"))
    ids, labels = candidates.column("id").to_numpy(), candidates.column("label").to_numpy()
    order = np.argsort(ids, kind="stable")
    for at in range(0, len(order), chunk):
        rows = order[at : at + chunk]
        yield strassen(a, _matrix(candidates.column("q").take(pa.array(rows))).T), labels[rows], ids[rows]


def _best(scores: np.ndarray) -> np.ndarray:
    """Order of descending scores, equal ones as they come."""
    return np.argsort(~scores, kind="stable")  # ~s is -s - 1 and can't overflow


def quantised(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, scale: int) -> DataFrame:
    """(id, label, dim, q): the rows that take part, equal ones once, components floor(scale * x)."""
    v = F.col(vector_col).cast("array<double>")
    scaled = F.transform(v, lambda x: x * F.lit(float(scale)))
    sound = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & F.coalesce(
        F.forall(scaled, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float(2**63))), F.lit(False)
    )
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.transform(scaled, lambda x: F.floor(x)).cast("array<long>").alias("q"))
    return rows.groupBy("id", "label", "q").agg(F.size("q").alias("dim"))


def hard_negatives(
    vectors: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 5,
    low: int = 80,
    high: int = 100,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    anchor_tile: int = 1024,
    stripe: int = 8192,
    chunk: int = 2048,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    A score is the integer inner product of floor(``scale`` * x) of two rows. The
    ``positives`` of an anchor (rows that fulfil ``anchor``, a Column over ``id``) are its
    best other rows of its label; for each of them the ``negatives`` best rows of other
    labels with ``low`` <= 100 * score / positive score <= ``high``. Ties go to smaller ids.

    Anchors are dealt to tiles of about ``anchor_tile`` rows, all rows to stripes of
    about ``stripe`` (by hash, whatever their label); each pair of a tile and a
    stripe is one cell, a task's unit: the anchors times a chunk of candidates at a
    time by :func:`strassen`. A cell keeps one heap an anchor (first pass) or one a
    positive's window (second pass); the heaps of all stripes are merged by a ranked
    window that keeps the best of each task ahead of the shuffle. Rows move once for
    each tile, anchors once for each stripe; a cell's memory is bounded by both sizes.

    Rows with a null id or label, a null vector or a null or non-finite component
    take no part, nor those with a component beyond 64 bits once scaled. Vectors
    meet those of equal length alone. Equal rows count once; rows of one id with
    different vectors or labels are rows of their own, but never each other's positive or
    negative. Scores beyond 64 bits wrap around. Extra columns are not looked at; an empty
    table or one without anchors gives an empty result.
    """
    spark = vectors.sparkSession
    python_batches(spark)
    rows = cut(quantised(vectors, id_col, vector_col, label_col, scale))
    anchors = rows.where(anchor).withColumn("akey", F.xxhash64("label", "q"))
    n_rows, n_anchors = rows.count(), anchors.count()
    tiles, stripes = max(1, -(-n_anchors // anchor_tile)), max(1, -(-n_rows // stripe))
    dealt = lambda name, n: F.pmod(F.xxhash64(F.lit(name), "id", "q"), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    cells = ("dim", "i", "j")
    right = rows.withColumn("j", dealt("stripe", stripes)).withColumn("i", each(tiles))
    right = right.toDF(*right.columns).groupBy(*cells)  # columns of its own: both sides come from the same rows

    def against(left: DataFrame, f, schema: str) -> DataFrame:
        placed = left.withColumn("i", dealt("tile", tiles)).withColumn("j", each(stripes))
        return placed.groupBy(*cells).cogroup(right).applyInArrow(f, schema)

    def find_positives(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, labels = left.column("id").to_numpy(), left.column("label").to_numpy()
        heaps = [Heap(positives) for _ in ids]
        for scores, their, other in _tiles(left, right, chunk) if len(ids) else ():
            for k, heap in enumerate(heaps):
                at = np.flatnonzero((their == labels[k]) & (other != ids[k]))
                s = scores[k, at]
                if (least := heap.least()) is not None:
                    at, s = at[s >= least], s[s >= least]
                best = _best(s)[:positives]
                heap.merge(s[best], other[at[best]])
        out = [(int(a), int(key), s, i) for a, key, heap in zip(ids, left.column("akey").to_numpy(), heaps) for s, i in heap.pairs()]
        return _table(out, ("anchor_id", "akey", "positive_score", "positive_id"))

    def find_negatives(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, labels, wanted = left.column("id").to_numpy(), left.column("label").to_numpy(), left.column("scores").to_pylist()
        # low * p <= 100 * s <= high * p in whole numbers of any size
        windows = [[(-((-low * p) // 100), high * p // 100) for p in of] for of in wanted]
        heaps = [[Heap(negatives) for _ in of] for of in wanted]
        for scores, their, other in _tiles(left, right, chunk) if len(ids) else ():
            for k, of in enumerate(windows):
                open_ = [(lo, hi, h) for (lo, hi), h in zip(of, heaps[k]) if lo <= hi]
                if not open_:
                    continue
                row = scores[k]
                at = np.flatnonzero((their != labels[k]) & (other != ids[k]) & (row >= min(w[0] for w in open_)) & (row <= max(w[1] for w in open_)))
                at = at[_best(row[at])]
                falling = ~row[at]
                for lo, hi, heap in open_:
                    first = np.searchsorted(falling, ~hi)
                    last = min(first + negatives, np.searchsorted(falling, ~lo, "right"))
                    heap.merge(row[at[first:last]], other[at[first:last]])
        keys = left.column("akey").to_numpy()
        out = [(int(a), int(key), p, s, i) for a, key, of in zip(ids, keys, heaps) for p, heap in enumerate(of) for s, i in heap.pairs()]
        return _table(out, ("anchor_id", "akey", "place", "negative_score", "negative_id"))

    found = against(anchors, find_positives, "anchor_id long, akey long, positive_score long, positive_id long")
    by_anchor = Window.partitionBy("anchor_id", "akey").orderBy(F.col("positive_score").desc(), "positive_id")
    top = found.withColumn("place", (F.row_number().over(by_anchor) - 1).cast("long")).where(F.col("place") < positives)
    top = cut(top)
    listed = top.groupBy("anchor_id", "akey").agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("p"))  # at most ``positives``
    asking = anchors.join(listed.withColumnRenamed("anchor_id", "id"), ["id", "akey"]).select("id", "akey", "label", "dim", "q", F.col("p.positive_score").alias("scores"))
    found = against(asking, find_negatives, "anchor_id long, akey long, place long, negative_score long, negative_id long")
    by_window = Window.partitionBy("anchor_id", "akey", "place").orderBy(F.col("negative_score").desc(), "negative_id")
    kept = found.withColumn("rank", F.row_number().over(by_window)).where(F.col("rank") <= negatives)
    return kept.join(top, ["anchor_id", "akey", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _table(rows: list[tuple], names: tuple[str, ...]) -> pa.Table:
    return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(names, zip(*rows) if rows else [[]] * len(names))})


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are the rows of ``embeddings`` whose id is divisible by 100, against all rows; rows that can't be scored take no part."""
    rows = read(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives(rows, F.col("id") % 100 == 0)


OP11_SQL = """
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
pairs as (
  select a.vec_id as a, a.label = c.label as same, c.vec_id as c, list_inner_product(a.q, c.q)::bigint as s
  from v a join v c on a.vec_id <> c.vec_id and len(a.q) = len(c.q) where a.vec_id % 100 = 0),
pos as (select a, c as p, s as ps from pairs where same qualify row_number() over (partition by a order by s desc, c) <= 5),
neg as (
  select pos.a, p, ps, c, s, row_number() over (partition by pos.a, p order by s desc, c) as r
  from pos join pairs on pos.a = pairs.a where not same and 80 * ps <= 100 * s and 100 * s <= 100 * ps)
select a as anchor_id, p as positive_id, r::int as rank, c as negative_id, ps as positive_score, s as negative_score from neg where r <= 5
"""
