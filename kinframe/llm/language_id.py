"""Operator 2: language identification by a byte convolutional network."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinframe.llm.common import python_batches, read, refuse_clash, widened

WIDTHS, FILTERS, EMBED, WINDOW = (2, 3, 4), 16, 8, 256
_letter = regex.compile(r"\p{L}").search


def windows(text: str) -> np.ndarray:
    """The whole text as fixed-length byte windows; the last one is padded with zeros."""
    raw = text.lower().encode()
    raw += b"\0" * (-len(raw) % WINDOW)
    return np.frombuffer(raw, np.uint8).reshape(-1, WINDOW)


@dataclass
class ByteConvNet:
    """Byte embedding, filters of several widths, max pooling over positions, softmax."""

    langs: list[str]
    embed: np.ndarray
    filters: list[np.ndarray]
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def fresh(cls, langs: list[str], seed: int = 7) -> ByteConvNet:
        r = np.random.default_rng(seed)
        w = [r.normal(0, 1 / np.sqrt(k * EMBED), (k * EMBED, FILTERS)).astype(np.float32) for k in WIDTHS]
        return cls(langs, r.normal(0, 1, (256, EMBED)).astype(np.float32), w, np.zeros((FILTERS * len(WIDTHS), len(langs)), np.float32), np.zeros(len(langs), np.float32))

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = 4, batch: int = 64, rate: float = 0.01, seed: int = 11) -> ByteConvNet:
        """Adam on cross entropy; gradients of a max pass to the winning position alone."""
        r, n = np.random.default_rng(seed), len(x)
        params = [self.embed, *self.filters, self.out, self.bias]
        m, v, t = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
        for _ in range(epochs):
            for at in np.array_split(r.permutation(n), max(1, n // batch)):
                xb, yb, rows = x[at].astype(np.int64), y[at], np.arange(len(at))
                e = self.embed[xb]
                pooled, won = [], []
                for k, w in zip(WIDTHS, self.filters):
                    cols = np.concatenate([e[:, j : WINDOW - k + 1 + j] for j in range(k)], axis=2)
                    z = cols @ w
                    a = z.argmax(axis=1)
                    won.append((a, cols[rows[:, None], a]))
                    pooled.append(np.take_along_axis(z, a[:, None], 1)[:, 0])
                h0 = np.concatenate(pooled, axis=1)
                h = np.maximum(h0, 0)
                p = _softmax(h @ self.out + self.bias)
                p[rows, yb] -= 1
                p /= len(at)
                dh = (p @ self.out.T) * (h0 > 0)
                de, dw = np.zeros_like(self.embed), []
                for i, (k, w) in enumerate(zip(WIDTHS, self.filters)):
                    a, cols = won[i]
                    d = dh[:, i * FILTERS : (i + 1) * FILTERS]
                    dw.append(np.einsum("bfc,bf->cf", cols, d))
                    dcols = d[:, :, None] * w.T[None]
                    for j in range(k):
                        np.add.at(de, xb[rows[:, None], a + j], dcols[:, :, j * EMBED : (j + 1) * EMBED])
                t += 1
                for q, g, mm, vv in zip(params, [de, *dw, h.T @ p, p.sum(0)], m, v):
                    mm += 0.1 * (g - mm)
                    vv += 0.001 * (g * g - vv)
                    q -= rate * (mm / (1 - 0.9**t)) / (np.sqrt(vv / (1 - 0.999**t)) + 1e-8)
        return self

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Filter responses of byte pairs and bytes, so that a convolution is a few look-ups and sums."""
        part = [[self.embed @ w[j * EMBED : (j + 1) * EMBED] for j in range(k)] for k, w in zip(WIDTHS, self.filters)]
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
        first = np.concatenate([pair(p[0], p[1]) for p in part], axis=1)
        return first.astype(np.float32), part[1][2].astype(np.float32), pair(part[2][2], part[2][3]).astype(np.float32)

    def predict(self, x: np.ndarray, tables, block: int = 48) -> np.ndarray:
        """Class probabilities of each window."""
        first, third, rest = tables
        out = np.empty((len(x), len(self.langs)), np.float32)
        f = FILTERS
        for i in range(0, len(x), block):
            b = x[i : i + block].astype(np.int32)
            pair = b[:, :-1] << 8 | b[:, 1:]
            z = first[pair]
            z3 = z[:, :-1, f : 2 * f] + third[b[:, 2:]]
            z4 = z[:, :-2, 2 * f :] + rest[pair[:, 2:]]
            h = np.concatenate([z[:, :, :f].max(axis=1), z3.max(axis=1), z4.max(axis=1)], axis=1)
            out[i : i + block] = _softmax(np.maximum(h, 0) @ self.out + self.bias)
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_lang: int = 300, windows_per_doc: int = 6, most_langs: int = 200) -> ByteConvNet | None:
    """Fit on a bounded sample: per language the ``docs_per_lang`` texts of least id hash, ``windows_per_doc`` windows of each.

    Only texts with a letter and a language take part, of the ``most_langs`` most
    frequent languages (a bound for labels that are not clean). The sample is drawn
    by a hash threshold from exact counts per language, so no group meets in one
    task; the driver gets the windows, not the texts. Rows that repeat an id are
    drawn together. Returns None where nothing is labelled (an empty table too).
    """
    spark = labelled.sparkSession
    python_batches(spark)
    usable = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    draw = F.xxhash64(F.lit("language sample"), F.col(id_col))
    counts = {r[0]: r[1] for r in labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).groupBy(lang_col).count().orderBy(F.desc("count"), lang_col).limit(most_langs).collect()}
    if not counts:
        return None
    limit = F.create_map(*(x for lang, n in counts.items() for x in (F.lit(lang), F.lit(int(min(2**62, 3 * docs_per_lang / n * 2**62))))))[F.col(lang_col)]
    drawn = usable.where(F.shiftrightunsigned(draw, 2) < limit).select(draw.alias("draw"), F.col(lang_col), F.col(text_col))

    def cut(batches):
        for batch in batches:
            h, lang, x = [], [], []
            for d, g, t in zip(*(c.to_pylist() for c in batch.columns)):
                w = windows(t)
                pick = np.random.default_rng(abs(d)).permutation(len(w))[:windows_per_doc]
                h.append(d)
                lang.append(g)
                x.append(w[np.sort(pick)].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(h, pa.int64()), pa.array(lang, pa.string()), pa.array(x, pa.binary())], ["draw", "lang", "x"])

    rows = sorted(drawn.mapInArrow(cut, "draw long, lang string, x binary").collect(), key=lambda r: (r.draw, r.lang, bytes(r.x)))
    langs, x, y, taken = sorted(counts), [], [], dict.fromkeys(counts, 0)
    for r in rows:
        if taken[r.lang] < docs_per_lang:
            taken[r.lang] += 1
            w = np.frombuffer(bytes(r.x), np.uint8).reshape(-1, WINDOW)
            x.append(w)
            y += [langs.index(r.lang)] * len(w)
    if not x:
        return None
    return ByteConvNet.fresh(langs).fit(np.concatenate(x), np.array(y))


def predict_languages(docs: DataFrame, model: ByteConvNet | None, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row with ``lang_pred`` and ``score``.

    Every window of the whole text is scored; the text's probabilities are the
    mean over its bytes. Null text, and text without a letter, is ``und`` with
    score 0; so is every text where no model could be trained. Map only: no
    shuffle, memory bounded by small Arrow batches. Repeated rows are each scored,
    an empty table gives an empty result; columns that are not in ``keep`` are not
    looked at, and one in it named like a new one is an error.
    """
    refuse_clash(docs, keep, ("lang_pred", "score", "__text"))
    python_batches(docs.sparkSession)
    chosen = docs.select(*keep, F.col(text_col).alias("__text"))

    def run(batches):
        tables = model.tables() if model else None
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            lang, score = ["und"] * len(texts), np.zeros(len(texts))
            known = [i for i, t in enumerate(texts) if model and t and _letter(t)]
            if known:
                parts = [windows(texts[i]) for i in known]
                p = model.predict(np.concatenate(parts), tables)
                weight = np.concatenate([np.count_nonzero(w, axis=1) for w in parts]).astype(np.float64)
                starts = np.cumsum([0] + [len(w) for w in parts[:-1]])
                mean = np.add.reduceat(p * weight[:, None], starts) / np.add.reduceat(weight, starts)[:, None]
                for i, k in enumerate(known):
                    lang[k] = model.langs[int(mean[i].argmax())]
                    score[k] = min(1.0, float(mean[i].max()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*batch.schema.names[:-1], "lang_pred", "score"])

    schema = widened(chosen.drop("__text"), "lang_pred string, score double")
    return chosen.mapInArrow(run, schema)


def fold(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n."""
    return F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")) % n


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document of ``documents``, learnt from the ids outside the held-out fold; `und` where there is no letter."""
    docs = read(spark, sf_dir, "documents")
    model = train(docs.where(fold("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    out = predict_languages(docs, model)
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
