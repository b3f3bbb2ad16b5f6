"""Operator 4: toxicity by multiple-instance learning over sentences."""

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

BITS = 20
_sentence = regex.compile(r"[^.!?\n]+").finditer
_word = regex.compile(r"[\p{L}\p{M}\p{N}]+").findall


def grams(word: str) -> list[int]:
    """Hash buckets of a word, and of the runs of 4 and 5 characters in it (its ends marked)."""
    marked = f"^{word}$"
    parts = {word, *(marked[i : i + n] for n in (4, 5) for i in range(len(marked) - n + 1))}
    return [xxhash.xxh3_64_intdigest(p.encode()) >> (64 - BITS) for p in sorted(parts)]


def instances(text: str) -> tuple[list[set[str]], list[tuple[int, int]]]:
    """Distinct words of each sentence that has a word, and its span in the text."""
    words, spans = [], []
    for m in _sentence(text):
        found = _word(m.group().lower())
        if found:
            words.append(set(found))
            spans.append(m.span())
    return words, spans


@dataclass
class NoisyOr:
    """Sentence logits from hashed words and their character runs; a document is toxic unless no sentence is."""

    weights: np.ndarray
    bias: float

    def __post_init__(self):
        self.memory = Remembered()

    def word(self, word: str) -> float:
        """Sum of a word's weights, remembered within bounds."""
        v = self.memory.get(word)
        if v is None:
            v = self.memory.older.get(word)
            v = self.memory.put(word, float(self.weights[grams(word)].sum()) if v is None else v)
        return v

    def logits(self, sentences: list[set[str]]) -> np.ndarray:
        word = self.word
        return np.array([sum(map(word, sorted(s))) for s in sentences]) + self.bias

    def fit(self, words: list[str], coded: list[tuple[np.ndarray, np.ndarray]], y_all: np.ndarray, epochs: int = 6, least_steps: int = 400, batch: int = 64, rate: float = 0.1, decay: float = 1e-5, rare: int = 4, seed: int = 3) -> NoisyOr:
        """Adagrad on document log loss. Character runs in under ``rare`` documents keep weight 0.

        A document of ``coded`` is the places in ``words`` of its sentences' words and the sentences' lengths.
        With S the sum of softplus over a document's sentence logits its
        probability is 1 - exp(-S); that gives each sentence its share of the
        document's error, so only document labels are needed.
        """
        each = [np.array(grams(w), np.int32) for w in words]
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        flat, first = np.concatenate(each), np.concatenate(([0], np.cumsum(sizes)))
        seen = np.zeros(len(self.weights), np.int32)
        for idx, _ in coded:
            seen[np.unique(np.concatenate([each[i] for i in np.unique(idx)]))] += 1
        del each
        open_ = seen >= rare
        r, g2, b2 = np.random.default_rng(seed), np.full(len(self.weights), 1e-4), 1e-4
        for _ in range(max(epochs, -(-least_steps * batch // len(coded)))):
            for at in np.array_split(r.permutation(len(coded)), max(1, len(coded) // batch)):
                y, part = y_all[at], [coded[i] for i in at]
                idx, lens = np.concatenate([d[0] for d in part]), np.concatenate([d[1] for d in part])
                used, back = np.unique(idx, return_inverse=True)
                n = sizes[used]
                ends = np.cumsum(n)
                where = np.repeat(first[used] - ends + n, n) + np.arange(ends[-1])
                f = flat[where]
                u = np.add.reduceat(self.weights[f], ends - n)
                of = np.repeat(np.arange(len(part)), [len(d[1]) for d in part])
                z = np.add.reduceat(u[back], np.concatenate(([0], np.cumsum(lens)[:-1]))) + self.bias
                p = 1 / (1 + np.exp(-z))
                s = np.bincount(of, np.logaddexp(0, z), len(part))
                share = np.where(y == 1, -1 / np.expm1(np.clip(s, 1e-9, 700)), 1.0)
                dz = p * share[of] / len(part)
                du = np.bincount(back, np.repeat(dz, lens), len(used))
                hit, of_hit = np.unique(f, return_inverse=True)
                g = np.where(open_[hit], np.bincount(of_hit, np.repeat(du, n), len(hit)) + decay * self.weights[hit], 0)
                g2[hit] += g * g
                self.weights[hit] -= rate * g / np.sqrt(g2[hit])
                gb = dz.sum()
                b2 += gb * gb
                self.bias -= 0.1 * gb / np.sqrt(b2)
        return self


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", docs_per_class: int = 2000, longest: int = 10_000) -> NoisyOr | None:
    """Fit on a bounded sample: per class the ``docs_per_class`` labelled documents of least id hash.

    The ids drawn are broadcast (about 1.5 times the bound at most), so no text is shuffled.
    The sample takes texts of at most ``longest`` characters that have a word; the
    driver gets the distinct words of their sentences as Arrow columns and numbers them. Rows with a null label or id
    are left out, of repeated labels the greatest counts, rows that repeat an id are
    drawn together. None where a class is missing (an empty table too).
    """
    python_batches(docs.sparkSession)
    draw = F.xxhash64(F.lit("toxicity sample"), F.col("id"))
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    if len(counts) < 2:
        return None
    limit = F.create_map(*(x for c, n in counts.items() for x in (F.lit(c), F.lit(int(min(2**62, 1.5 * docs_per_class / n * 2**62))))))[F.col("y")]
    drawn = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") <= longest).join(F.broadcast(known.where(F.shiftrightunsigned(draw, 2) < limit)), "id")

    def extract(batches):
        for batch in batches:
            out = [(d, y, [sorted(s) for s in instances(t)[0]]) for d, y, t in zip(*(c.to_pylist() for c in batch.columns))]
            d, y, sentences = zip(*(x for x in out if x[2])) if any(x[2] for x in out) else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(y, pa.int32()), pa.array(sentences, pa.list_(pa.list_(pa.string())))], ["draw", "y", "sentences"])

    bags = drawn.select(draw.alias("draw"), "y", "text").mapInArrow(extract, "draw long, y int, sentences array<array<string>>").toArrow().combine_chunks()
    at, y = _first(bags, docs_per_class), bags.column("y").to_numpy()
    if len(np.unique(y[at])) < 2:
        return None
    words, coded = _coded(bags.column("sentences").take(pa.array(at)))
    return NoisyOr(np.zeros(1 << BITS), -7.0).fit(words, coded, y[at])


def _first(bags: pa.Table, most: int) -> np.ndarray:
    """Rows of the first ``most`` documents of each class, by draw, class and (where both are equal) sentences."""
    draw, y = bags.column("draw").to_numpy(), bags.column("y").to_numpy()
    order = np.lexsort((y, draw))
    same = np.flatnonzero((draw[order][1:] == draw[order][:-1]) & (y[order][1:] == y[order][:-1]))
    for run in np.split(same, np.flatnonzero(np.diff(same) > 1) + 1) if len(same) else ():
        span = slice(run[0], run[-1] + 2)
        order[span] = sorted(order[span], key=lambda i: bags.column("sentences")[int(i)].as_py())
    kept = np.concatenate([np.flatnonzero(y[order] == c)[:most] for c in (0, 1)])
    return order[np.sort(kept)]


def _coded(sentences: pa.ChunkedArray) -> tuple[list[str], list[tuple[np.ndarray, np.ndarray]]]:
    """The distinct words in order, and each document as :meth:`NoisyOr.fit` takes it; no word is made a string more than once."""
    words, coded, known = [], [], {}
    for chunk in sentences.chunks:
        inner = chunk.flatten()
        coding = inner.flatten().dictionary_encode()
        codes = np.array([known.setdefault(w, len(known)) for w in coding.dictionary.to_pylist()], np.int32)[coding.indices.to_numpy()]
        lens, counts = inner.value_lengths().to_numpy().astype(np.int64), chunk.value_lengths().to_numpy()
        rows = np.concatenate(([0], np.cumsum(lens)))
        ends = np.cumsum(counts)
        coded += [(codes[rows[e - n] : rows[e]], lens[e - n : e]) for e, n in zip(ends, counts)]
    words = sorted(known)
    rank = np.empty(len(known), np.int32)
    rank[[known[w] for w in words]] = np.arange(len(words), dtype=np.int32)
    return words, [(rank[idx], lens) for idx, lens in coded]


def score_toxicity(docs: DataFrame, model: NoisyOr | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",), sentence_at: float = 0.5) -> DataFrame:
    """Columns ``keep`` of every row with ``score`` and the offending sentences.

    ``score`` is the noisy-or over all sentences of the whole text, ``sentences``
    lists (start, end, score) in code points of those at ``sentence_at`` or more.
    Texts that are null or have no word score 0 and have no sentences; so has
    every text where no model could be trained. Map only, no shuffle. Repeated rows
    are each scored, an empty table gives an empty result; columns that are not in
    ``keep`` are not looked at, and one in it named like a new one is an error.
    """
    refuse_clash(docs, keep, ("score", "sentences", "__text"))
    python_batches(docs.sparkSession)
    chosen = docs.select(*keep, F.col(text_col).alias("__text"))
    weights, bias = (model.weights.astype(np.float32), model.bias) if model else (None, 0.0)

    def run(batches):
        net = NoisyOr(weights, bias) if weights is not None else None
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            scores, marks = [], []
            for t in batch.column(batch.num_columns - 1).to_pylist():
                sentences, spans = instances(t) if t and net else ([], [])
                if not sentences:
                    scores.append(0.0)
                    marks.append([])
                    continue
                z = net.logits(sentences)
                scores.append(float(-np.expm1(-np.logaddexp(0, z).sum())))
                p = 1 / (1 + np.exp(-z))
                marks.append([{"start": spans[i][0], "end": spans[i][1], "score": float(p[i])} for i in np.flatnonzero(p >= sentence_at)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64()), pa.array(marks, kind)], [*batch.schema.names[:-1], "score", "sentences"])

    schema = widened(chosen.drop("__text"), "score double, sentences array<struct<start:int,end:int,score:double>>")
    return chosen.mapInArrow(run, schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document of ``documents``, learnt from the labels outside the held-out fold; null and wordless texts score 0."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    model = train(docs, labels.where(fold("doc_id", 5) != 0))
    out = score_toxicity(docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("sentences").alias("n_sentences"))
