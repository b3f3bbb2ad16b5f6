"""Operator 9: text quality by ordinal cumulative-link regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinframe.llm.common import Remembered, python_batches, read, refuse_clash, widened
from kinframe.llm.language_id import fold

BITS = 18
_capitals, _digits, _equal = (regex.compile(p) for p in (r"\p{Lu}+", r"\p{N}+", r"(.)\1+"))
_letters = regex.compile(r"[\p{L}--A]+", regex.V1)


def buckets(word: str) -> int:
    """Hash buckets of a word and of its shape (runs of capitals, letters, digits and equal signs made one), in one number."""
    shape = _equal.sub(r"\1", _digits.sub("0", _letters.sub("a", _capitals.sub("A", word))))
    hashed = lambda x: xxhash.xxh3_64_intdigest(x.encode()) >> (64 - BITS)
    return hashed("w " + word.lower()) << 32 | hashed("s " + shape)


def features(text: str, memory: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words, word shapes, and the share of words equal to the one before, each block of unit length; ``memory`` is the task's."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    found = list(map(memory.get, words))
    if None in found:
        for w in memory.unknown(set(words)):
            memory[w] = buckets(w)
        found = list(map(memory.__getitem__, words))
    both = np.array(found, np.int64)
    word, shape = both >> 32, both & 0xFFFFFFFF
    (wi, wn), (si, sn) = (np.unique(x, return_counts=True) for x in (word, shape))
    wx, sx = np.log1p(wn), sn / len(words)
    repeated = (word[1:] == word[:-1]).mean() if len(words) > 1 else 0.0
    own = np.array([min(1.0, 4 * repeated), len(wi) / len(words)])
    return np.concatenate((wi, si, [0, 1])), np.concatenate((0.5 * wx / np.sqrt(wx @ wx), sx / np.sqrt(sx @ sx), own))


@dataclass
class CumulativeLink:
    """P(grade > k) = sigmoid(w.x - t_k) with t_0 < t_1 < ...: one direction, ordered thresholds."""

    weights: np.ndarray
    first: float
    gaps: np.ndarray

    @property
    def thresholds(self) -> np.ndarray:
        return self.first + np.concatenate(([0.0], np.cumsum(np.logaddexp(0, self.gaps))))

    def tails(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(self.thresholds[None] - np.asarray(z)[:, None]))

    def fit(self, docs: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 12, batch: int = 64, rate: float = 0.2, decay: float = 1e-5, seed: int = 5) -> CumulativeLink:
        """Adagrad on the log likelihood of the grade, grades weighing the same."""
        r, k = np.random.default_rng(seed), len(self.gaps) + 1
        g2, t2 = np.full(len(self.weights), 1e-6), np.full(k, 1e-6)
        y_all = np.array([d[2] for d in docs])
        weigh = len(docs) / ((k + 1) * np.maximum(1, np.bincount(y_all, minlength=k + 1)))
        for _ in range(epochs):
            for at in np.array_split(r.permutation(len(docs)), max(1, len(docs) // batch)):
                part = [docs[i] for i in at]
                lens = np.array([len(d[0]) for d in part])
                idx, x = np.concatenate([d[0] for d in part]), np.concatenate([d[1] for d in part])
                y, of = np.array([d[2] for d in part]), np.repeat(np.arange(len(part)), lens)
                z = np.bincount(of, self.weights[idx] * x, len(part))
                tail = np.concatenate([np.ones((len(part), 1)), self.tails(z), np.zeros((len(part), 1))], axis=1)
                rows = np.arange(len(part))
                p = np.maximum(tail[rows, y] - tail[rows, y + 1], 1e-12)
                slope = tail * (1 - tail)
                c = weigh[y] / len(part)
                dz = -c * (slope[rows, y] - slope[rows, y + 1]) / p
                dt = np.zeros((len(part), k + 2))
                dt[rows, y] += c * slope[rows, y] / p
                dt[rows, y + 1] -= c * slope[rows, y + 1] / p
                dt = dt[:, 1:-1].sum(axis=0)
                g = np.bincount(idx, dz[of] * x, len(self.weights)) + decay * self.weights
                g2 += g * g
                self.weights -= rate * g / np.sqrt(g2)
                later = np.cumsum(dt[::-1])[::-1]  # a gap moves all thresholds above it
                grad = np.concatenate(([later[0]], later[1:] / (1 + np.exp(-self.gaps))))
                t2 += grad * grad
                step = 0.1 * grad / np.sqrt(t2)
                self.first -= step[0]
                self.gaps -= step[1:]
        return self


def train(docs: DataFrame, grades: DataFrame, n_grades: int, id_col: str = "doc_id", text_col: str = "text", grade_col: str = "grade", docs_per_grade: int = 2000) -> CumulativeLink | None:
    """Fit on a bounded sample: per grade the ``docs_per_grade`` graded documents of least id hash.

    The ids drawn are broadcast (about 1.5 times the bound at most), so no text is shuffled.
    Grades are 0 to ``n_grades`` - 1; rows with a null or other grade, a null id
    or no word are left out. None where fewer than two grades are seen.
    """
    python_batches(docs.sparkSession)
    draw = F.xxhash64(F.lit("quality sample"), F.col("id"))
    known = grades.select(F.col(id_col).alias("id"), F.col(grade_col).cast("int").alias("y")).where(f"id is not null and y between 0 and {n_grades - 1}").groupBy("id").agg(F.max("y").alias("y"))
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        return None
    limit = F.create_map(*(x for c, n in counts.items() for x in (F.lit(c), F.lit(int(min(2**62, 1.5 * docs_per_grade / n * 2**62))))))[F.col("y")]
    drawn = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(known.where(F.shiftrightunsigned(draw, 2) < limit)), "id").select(draw.alias("draw"), "y", "text")

    def extract(batches):
        memory = Remembered()
        for batch in batches:
            d, y, i, x = [], [], [], []
            for a, c, t in zip(*(col.to_pylist() for col in batch.columns)):
                idx, val = features(t, memory)
                if len(idx):
                    d.append(a)
                    y.append(c)
                    i.append(idx.astype(np.int32).tobytes())
                    x.append(val.astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(y, pa.int32()), pa.array(i, pa.binary()), pa.array(x, pa.binary())], ["draw", "y", "i", "x"])

    rows = sorted(drawn.mapInArrow(extract, "draw long, y int, i binary, x binary").collect(), key=lambda r: (r.draw, r.y, bytes(r.i)))
    taken, sample = dict.fromkeys(range(n_grades), 0), []
    for r in rows:
        if taken[r.y] < docs_per_grade:
            taken[r.y] += 1
            sample.append((np.frombuffer(bytes(r.i), np.int32), np.frombuffer(bytes(r.x), np.float32).astype(np.float64), r.y))
    if not sample:
        return None
    return CumulativeLink(np.zeros(1 << BITS), -1.0, np.zeros(n_grades - 2)).fit(sample)


def score_quality(docs: DataFrame, model: CumulativeLink | None, n_grades: int, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row with ``expected_grade`` and ``tails``, the array of P(grade > k).

    Whole texts, map only. Null texts and texts without a word have grade 0 and
    tails 0; so has every text where no model could be trained. Repeated rows are
    each scored, an empty table gives an empty result; columns that are not in
    ``keep`` are not looked at, and one in it named like a new one is an error.
    """
    refuse_clash(docs, keep, ("expected_grade", "tails", "__text"))
    python_batches(docs.sparkSession)
    chosen = docs.select(*keep, F.col(text_col).alias("__text"))
    parts = (model.weights.astype(np.float32), model.first, model.gaps) if model else None

    def run(batches):
        net, memory = CumulativeLink(*parts) if parts else None, Remembered()
        for batch in batches:
            tails = []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                idx, x = features(t, memory) if t and net else ((), ())
                tails.append(net.tails([float(net.weights[idx] @ x)])[0].tolist() if len(idx) else [0.0] * (n_grades - 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([sum(t) for t in tails], pa.float64()), pa.array(tails, pa.list_(pa.float64()))], [*batch.schema.names[:-1], "expected_grade", "tails"])

    schema = widened(chosen.drop("__text"), "expected_grade double, tails array<double>")
    return chosen.mapInArrow(run, schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 junk, 1 sound but toxic, 2 sound. Kept: P(grade > 0) of at least one half."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    graded = labels.where(fold("doc_id", 5) != 0).select("doc_id", F.when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).when(F.col("quality") == 1, 2).alias("grade"))
    out = score_quality(docs, train(docs, graded, 3), 3)
    return out.select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "expected_grade",
        F.get("tails", 0).alias("tail_prob"), F.get("tails", 1).alias("top_prob"), (F.get("tails", 0) >= 0.5).cast("int").alias("keep"),
    )
