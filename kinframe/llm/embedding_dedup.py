"""Operator 10: near-duplicate vectors by a forest of random-projection trees."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinframe.llm.common import connected_components, cut, hash128, python_batches, read

#: Rows of the table of groups up to which it is broadcast.
FEW_GROUPS = 100_000


def directions(seed: int, dim: int, trees: int, depth: int) -> np.ndarray:
    """Unit vectors to split by, one for each level of each tree: (trees, dim, depth)."""
    v = np.random.default_rng((seed, dim)).normal(size=(trees, dim, depth))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def split_points(p: np.ndarray) -> np.ndarray:
    """Thresholds of one tree from the projections (rows x levels) of a sample: per node the median of its rows, 0 where it has none.

    Node k has children 2k and 2k + 1.
    """
    out, node = np.zeros(1 << p.shape[1], np.float32), np.ones(len(p), np.int64)
    for level in range(p.shape[1]):
        order = np.lexsort((p[:, level], node))
        first = np.flatnonzero(np.concatenate(([True], np.diff(node[order]) > 0)))
        count = np.diff(np.concatenate((first, [len(p)])))
        value = p[order, level]
        out[node[order][first]] = (value[first + (count - 1) // 2] + value[first + count // 2]) / 2
        node = 2 * node + (p[:, level] > out[node])
    return out


@dataclass
class Forest:
    """Trees of recursive random splits for vectors of each length; rows within ``spill`` of a threshold go to both sides.

    All nodes of a level of a tree split along one random direction, made anew from
    the seed, each at its own threshold; only thresholds are kept.
    """

    thresholds: dict[int, list[np.ndarray]]
    trees: int
    depth: int
    spill: float
    seed: int

    def leaves(self, x: np.ndarray, level: int, spill: float | None = None):
        """Per tree, (rows, nodes): which rows of ``x`` (of unit length) reach which node of ``level``; at level 0 all trees are one and the same."""
        if not level:
            yield np.arange(len(x)), np.ones(len(x), np.int64)
            return
        spill, cuts = self.spill if spill is None else spill, self.thresholds.get(x.shape[1])
        for t, along in enumerate(directions(self.seed, x.shape[1], self.trees, self.depth)):
            p, rows, node = x @ along, np.arange(len(x)), np.ones(len(x), np.int64)
            for k in range(level):
                q = p[rows, k] - (cuts[t][node] if cuts else 0.0)
                left, right = q <= spill, q > -spill
                rows, node = np.concatenate((rows[left], rows[right])), np.concatenate((2 * node[left], 2 * node[right] + 1))
            yield rows, node


def _level(nodes: np.ndarray, n_rows: int, least: int, depth: int, most: int) -> int:
    """The first level, ``least`` or deeper, at which half the rows of a group share their node with ``most`` rows or fewer.

    ``nodes`` has, per row of the group's sample and tree, the node of level ``depth``.
    """
    for level in range(least, depth):
        shared = []
        for t in range(nodes.shape[1]):
            _, at, n = np.unique(nodes[:, t] >> (depth - level), return_inverse=True, return_counts=True)
            shared.append(n[at])
        if np.median(shared) * n_rows / len(nodes) <= most:
            return level
    return depth


def _matrix(column: pa.ListArray) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def near_duplicates(
    vectors: DataFrame,
    at_least: float = 0.98,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    group_col: str = "label",
    trees: int = 6,
    leaf: int = 400,
    spill: float = 0.02,
    deepest: int = 20,
    sample_rows: int = 4000,
    most_sample_rows: int = 1 << 20,
    block: int = 1000,
    seed: int = 17,
) -> DataFrame:
    """(id, n_links, component, kept): links between vectors of equal group with cosine ``at_least`` or more.

    Equal vectors of a group are one class with its least id; the rest works on
    classes. All groups share one forest (for each vector length). It is fitted on a
    sample by id hash that grows with the leaves, 16 rows for each, from ``sample_rows``
    to ``most_sample_rows``: tasks project the sample, and one task for each tree finds
    its thresholds; the driver gets thresholds alone, at most 2 ** ``deepest`` for each
    tree (25 MB in all), which it broadcasts. A leaf is a node and a group. How deep a
    group goes follows its exact row count, and goes on where the splits leave its
    rows together (told by tasks from a sample of the group); every row is then sent
    down every tree, near a split to both sides. The table of groups of more than
    ``leaf`` classes (group, count, level) is broadcast where it has at most
    ``FEW_GROUPS`` rows, else joined.
    Leaves with more than ``block`` rows (of very many near copies, or
    beyond the deepest level) are compared as pairs of blocks, so that no task
    holds more than two blocks and no pair of a leaf is left out. Cosines are in
    double precision. A pair that meets in several leaves is counted in the first
    of them only, told from the leaves that both rows reach, so pairs are not shuffled:
    a task gives link counts per row and the edges of a spanning forest.

    Vectors that are null, zero or hold null or non-finite components, and rows of
    null group or id, link with nothing; vectors of a group link with those of equal
    length alone. Rows that repeat an id are rows of their own, links counted by row;
    they share the component. Extra columns are not looked at; an empty table gives
    an empty result.
    """
    spark = vectors.sparkSession
    python_batches(spark)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(group_col).alias("g"), F.col(vector_col).cast("array<double>").alias("v"))
    sound = F.col("id").isNotNull() & F.col("g").isNotNull() & F.coalesce(F.size("v") > 0, F.lit(False)) & F.coalesce(
        F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False)
    )
    h1, h2 = hash128(F.col("v"))
    valid = rows.where(sound).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumns({"dim": F.size("v"), "h1": h1, "h2": h2})  # + 0 makes -0 equal to 0
    classes = cut(valid.groupBy("g", "dim", "v").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    large = cut(classes.groupBy("g", "dim").agg(F.count("*").alias("n")).where(F.col("n") > leaf))
    total, groups = large.agg(F.sum("n"), F.count("*")).first()
    few = F.broadcast if groups <= FEW_GROUPS else lambda df: df
    depth = int(np.clip(np.ceil(np.log2(max(leaf, total or 0) / leaf)), 0, deepest))
    group_type = classes.schema["g"].dataType.simpleString()

    def drawn(share):
        limit = F.least(share * float(2**62), F.lit(float(2**62)))
        return F.shiftrightunsigned(F.xxhash64(F.lit("forest sample"), "rep"), 2) < limit

    def units(batch, at):
        x = _matrix(batch.column("v").take(pa.array(at)))
        return x, x / np.linalg.norm(x, axis=1, keepdims=True)

    def project(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in sorted(set(dims.tolist())):
                _, unit = units(batch, np.flatnonzero(dims == dim))
                for t, along in enumerate(directions(seed, dim, trees, depth)):
                    p = (unit @ along).astype(np.float32)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), dim), pa.int32()), pa.array(np.full(len(p), t), pa.int32()), pa.array([r.tobytes() for r in p], pa.binary())], ["dim", "tree", "p"])

    def fit_tree(pdf):
        p = np.stack([np.frombuffer(r, np.float32) for r in pdf.p])
        return pdf[["dim", "tree"]].head(1).assign(cuts=split_points(p).tobytes())

    members = classes.join(few(large), ["g", "dim"])
    wanted = min(most_sample_rows, max(sample_rows, 16 << depth))
    fitted = members.where(drawn(F.lit(wanted / max(1, total or 0)))).select("dim", "v").mapInArrow(project, "dim int, tree int, p binary")
    thresholds: dict[int, list] = {}
    for r in sorted(fitted.groupBy("dim", "tree").applyInPandas(fit_tree, "dim int, tree int, cuts binary").collect() if depth else [], key=lambda r: (r.dim, r.tree)):
        thresholds.setdefault(r.dim, []).append(np.frombuffer(bytes(r.cuts), np.float32))
    shared = spark.sparkContext.broadcast(Forest(thresholds, trees, depth, spill, seed))

    def trace(batches):
        for batch in batches:
            dims, kept = batch.column("dim").to_numpy(), batch.select(["g", "dim", "n"])
            for dim in sorted(set(dims.tolist())):
                at = np.flatnonzero(dims == dim)
                nodes = np.ones((len(at), trees), np.int64)
                for t, (rows, node) in enumerate(shared.value.leaves(units(batch, at)[1], depth, 0.0)):
                    nodes[rows, t] = node
                yield pa.RecordBatch.from_arrays([*kept.take(pa.array(at)).columns, pa.array(nodes.tolist(), pa.list_(pa.int64()))], ["g", "dim", "n", "nodes"])

    def level_of(pdf):
        n = int(pdf.n.iloc[0])
        least = min(depth, int(np.ceil(np.log2(n / leaf))))
        return pdf[["g", "dim"]].head(1).assign(level=_level(np.stack(pdf.nodes), n, least, depth, 2 * leaf))

    traced = members.where(drawn(F.lit(float(sample_rows)) / F.col("n"))).select("g", "dim", "n", "v").mapInArrow(trace, f"g {group_type}, dim int, n long, nodes array<long>")
    measured = traced.groupBy("g", "dim").applyInPandas(level_of, f"g {group_type}, dim int, level int")
    by_count = F.least(F.lit(depth), F.ceil(F.log2(F.col("n") / leaf)).cast("int"))
    levels = cut(large.join(measured, ["g", "dim"], "left").select("g", "dim", F.coalesce("level", by_count).alias("level")))

    def descend(batches):
        for batch in batches:
            ids, copies, dims, levels = (batch.column(c).to_numpy() for c in ("rep", "copies", "dim", "level"))
            for dim, level in sorted(set(zip(dims.tolist(), levels.tolist()))):
                at = np.flatnonzero((dims == dim) & (levels == level))
                x, unit = units(batch, at)
                cells = [(rows, t << 32 | node) for t, (rows, node) in enumerate(shared.value.leaves(unit, level))]
                row, cell = (np.concatenate(c) for c in zip(*cells))
                order = np.argsort(row, kind="stable")
                reached = np.split(cell[order], np.cumsum(np.bincount(row, minlength=len(at)))[:-1])
                raw = [u.tobytes() for u in x]
                for rows, cell in cells:
                    yield pa.RecordBatch.from_arrays([
                        batch.column("g").take(pa.array(at[rows])), pa.array(np.full(len(rows), dim), pa.int32()), pa.array(cell, pa.int64()),
                        pa.array(ids[at[rows]], pa.int64()), pa.array(copies[at[rows]], pa.int64()),
                        pa.array([raw[m] for m in rows.tolist()], pa.binary()), pa.array([reached[m] for m in rows.tolist()], pa.list_(pa.int64())),
                    ], ["g", "dim", "cell", "id", "copies", "v", "reached"])

    leveled = classes.join(few(levels), ["g", "dim"], "left").select("g", "dim", "v", "rep", "copies", F.coalesce("level", F.lit(0)).alias("level"))
    cells = cut(leveled.mapInArrow(descend, f"g {group_type}, dim int, cell long, id long, copies long, v binary, reached array<long>"))
    counts = cells.groupBy("g", "dim", "cell").agg(F.count("*").alias("c")).where("c > 1").select("g", "dim", "cell", F.ceil(F.col("c") / block).cast("int").alias("blocks"))
    placed = cells.join(counts, ["g", "dim", "cell"]).withColumn("b", F.pmod(F.xxhash64(F.lit("block"), "id"), "blocks").cast("int"))
    spread = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "g", "dim", "cell", F.least("b", "other").alias("i"), F.greatest("b", "other").alias("j"), "b", "id", "copies", "v", "reached"
    )

    def compare(pdf):
        import pandas as pd

        i, j = int(pdf.i.iloc[0]), int(pdf.j.iloc[0])
        pdf = pdf.sort_values("id", ignore_index=True)
        x = np.stack([np.frombuffer(v, np.float64) for v in pdf.v])
        norm, b, ids, copies = np.linalg.norm(x, axis=1), pdf.b.to_numpy(), pdf.id.to_numpy(), pdf.copies.to_numpy()
        left = np.flatnonzero(b == i)
        right = left if i == j else np.flatnonzero(b == j)
        if not len(left) or not len(right):
            return pd.DataFrame({"id": [], "links": [], "to": []}).astype("int64")
        unit = x / norm[:, None]
        p, q = np.nonzero(unit[left] @ unit[right].T >= at_least - 1e-9)
        p, q = left[p], right[q]
        if i == j:
            p, q = p[p < q], q[p < q]
        exact = np.einsum("ij,ij->i", x[p], x[q]) / (norm[p] * norm[q]) >= at_least
        p, q = p[exact], q[exact]
        cell = int(pdf.cell.iloc[0])
        met = {m: frozenset(c for c in pdf.reached[m].tolist() if c < cell) for m in set(p.tolist()) | set(q.tolist())}
        first = np.array([met[m].isdisjoint(met[k]) for m, k in zip(p.tolist(), q.tolist())], bool)
        p, q = p[first], q[first]
        links = np.bincount(p, copies[q], len(x)) + np.bincount(q, copies[p], len(x))
        up = list(range(len(x)))

        def root(k):
            while up[k] != k:
                up[k] = up[up[k]]
                k = up[k]
            return k

        for m, k in zip(p.tolist(), q.tolist()):
            m, k = root(m), root(k)
            up[max(m, k)] = min(m, k)
        rows = np.flatnonzero(links)
        return pd.DataFrame({"id": ids[rows], "links": links[rows].astype("int64"), "to": [int(ids[root(int(k))]) for k in rows]})

    found = cut(spread.groupBy("g", "dim", "cell", "i", "j").applyInPandas(compare, "id long, links long, to long"))
    totals = found.groupBy("id").agg(F.sum("links").alias("others"))
    comp = connected_components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    per_class = (
        classes.select("g", "dim", h1.alias("h1"), h2.alias("h2"), "rep", "copies")
        .join(totals.withColumnRenamed("id", "rep"), "rep", "left")
        .join(comp.withColumnRenamed("node", "rep"), "rep", "left")
        .select("g", "dim", "h1", "h2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component"))
    )
    # cut, so that the join is one that Spark splits where a vector has very many copies
    linked = valid.select("id", "g", "dim", "h1", "h2").join(cut(per_class), ["g", "dim", "h1", "h2"]).select("id", "n_links", "component")
    alone = rows.where(~sound).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component"))
    out = linked.unionByName(alone)
    return out.select(F.col("id").alias(id_col), F.col("n_links").cast("long").alias("n_links"), "component", F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links within labels at cosine 0.98 over all of ``embeddings``; vectors that can't be compared are alone."""
    out = near_duplicates(read(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", F.col("component").alias("component_id"), "kept")
