"""Operator 3: benchmark decontamination by latent semantic retrieval."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinframe.llm.common import attach, cut, hash128, python_batches, read, widened

#: Words of an item's passage at most; words of a block; blocks of the windows that passages are looked for in.
PASSAGE, STRIDE, SPANS = 48, 16, (2, 3, 4)
#: A paraphrase holds so much of the answer's weight; an item of several passages is found by so much of one alone.
ANSWERED, WHOLE = 0.5, 0.95
_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 or 48 <= c <= 57 else 32 for c in range(256))
#: Partitions of the bounded sample.
SAMPLE_PARTS = 8
HITS = "array<struct<item:long,cosine:double,lcs:double,answer:double,start:int>>"


def words(text: str) -> list[bytes]:
    """Words in lower case, ASCII signs taken as blanks."""
    return text.lower().encode().translate(_FOLD).split()


def passages(item: list[bytes]) -> list[list[bytes]]:
    """An item in even parts of at most ``PASSAGE`` words."""
    n = max(1, math.ceil(len(item) / PASSAGE))
    return [item[i * len(item) // n : (i + 1) * len(item) // n] for i in range(n)]


def span(size: int) -> int:
    """Blocks of the smallest windows that a passage of ``size`` words fits into wherever it begins."""
    return min((k for k in SPANS if size <= (k - 1) * STRIDE + 1), default=SPANS[-1])


def answer_words(text: str) -> frozenset[bytes]:
    """The words of an item's last sentence with three words or more, which stand for its answer."""
    for part in reversed(text.replace("!", ".").replace("?", ".").replace("\n", ".").split(".")):
        if len(found := words(part)) >= 3:
            return frozenset(found)
    return frozenset(words(text))


def lcs(masks: dict[bytes, int], n: int, other: list[bytes]) -> int:
    """Length of the longest common subsequence, by bits: ``masks`` has the positions of each word of the one side."""
    row = (1 << n) - 1
    for w in other:
        hit = row & masks.get(w, 0)
        if hit:
            row = ((row + hit) | (row - hit)) & ((1 << n) - 1)
    return n - row.bit_count()


@dataclass
class Index:
    """Latent vectors of a block of items. A passage's owner is the text it was cut from; texts that share an item id are told apart."""

    vocab: dict[bytes, int]
    idf: np.ndarray
    basis: np.ndarray
    queries: np.ndarray
    owner: list[int]
    masks: list[dict[bytes, int]]
    sizes: list[int]
    answers: list[frozenset[bytes]]
    parts: list[int]
    items: list[int]

    def hits(self, texts: list[str | None], at_least: float, verbatim: float, paraphrase: float) -> list[list[dict]]:
        """Items found in each text: windows near to a passage by cosine, then held against it word by word."""
        docs, ids, first, n_blocks = [], [], [], []
        get, at = self.vocab.get, 0
        for t in texts:
            w = words(t) if t else []
            docs.append(w)
            m = max(SPANS[-1], -(-len(w) // STRIDE)) if w else 0
            row = np.zeros(m * STRIDE, np.int64)
            row[: len(w)] = [get(x, 0) for x in w]
            ids.append(row)
            first.append(at)
            n_blocks.append(m)
            at += m
        out: list[list[dict]] = [[] for _ in texts]
        if not at:
            return out
        flat = np.concatenate(ids).reshape(at, STRIDE)
        blocks = np.empty((at, self.basis.shape[1]), np.float32)
        for i in range(0, at, 1024):
            blocks[i : i + 1024] = self.basis[flat[i : i + 1024]].sum(axis=1)
        doc_of = np.repeat(np.arange(len(texts)), n_blocks)
        best: dict[tuple[int, int], tuple[float, float, float, int]] = {}
        spans, shares = np.array([span(n) for n in self.sizes]), [self._weights(q) for q in range(len(self.sizes))]
        for k in sorted(set(spans.tolist())):
            sums = sum(blocks[j : at - k + 1 + j] for j in range(k))
            good, wanted = np.flatnonzero(doc_of[: len(sums)] == doc_of[k - 1 :]), np.flatnonzero(spans == k)
            for i in range(0, len(good), 2048):
                rows = good[i : i + 2048]
                s = sums[rows]
                cos = (s @ self.queries[wanted].T) / np.maximum(np.sqrt((s * s).sum(axis=1, keepdims=True)), 1e-9)
                near = np.nonzero(cos >= at_least)
                for r, c, q in zip(rows[near[0]].tolist(), cos[near].tolist(), wanted[near[1]].tolist()):
                    d = int(doc_of[r])
                    start = (r - first[d]) * STRIDE
                    share, got = self.compare(q, shares[q], docs[d][start : start + k * STRIDE])
                    if share >= verbatim or (share >= paraphrase and got >= ANSWERED):  # each window by itself
                        best[d, q] = max(best.get((d, q), (0.0,)), (share, min(1.0, c), got, start))
        found: dict[tuple[int, int], list[tuple]] = {}
        for (d, q), v in sorted(best.items()):
            found.setdefault((d, self.owner[q]), []).append(v)
        told: dict[tuple[int, int], tuple] = {}
        for (d, text), v in found.items():
            if 2 * len(v) >= self.parts[text] or max(v)[0] >= WHOLE:
                told[d, self.items[text]] = max(told.get((d, self.items[text]), max(v)), max(v))
        for (d, item), (share, cosine, got, start) in sorted(told.items()):
            out[d].append({"item": item, "cosine": cosine, "lcs": share, "answer": got, "start": start})
        return out

    def _weights(self, q: int) -> dict[bytes, float]:
        """The words of a passage's answer with their shares of its weight."""
        weight = {x: float(self.idf[self.vocab[x]]) for x in self.answers[q]}
        total = max(1e-9, sum(weight.values()))
        return {x: v / total for x, v in weight.items()}

    def compare(self, q: int, shares: dict[bytes, float], window: list[bytes]) -> tuple[float, float]:
        """Shares of the passage in the longest common subsequence with a window, and of its answer's words in the window."""
        return lcs(self.masks[q], self.sizes[q], window) / self.sizes[q], sum(shares[x] for x in sorted(shares.keys() & set(window)))


def _document_frequencies(docs: DataFrame, text_col: str, vocab: dict[bytes, int]) -> tuple[np.ndarray, int]:
    """In how many documents each word of the vocabulary occurs, over all documents; and how many there are."""

    def count(batches):
        known, seen, n = vocab.keys(), np.zeros(len(vocab) + 1, np.int64), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                n += 1
                if t:
                    seen[[vocab[w] for w in known & set(words(t))]] += 1
        seen[0] = n
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(seen[at], pa.int64())], ["word", "n"])

    out = np.zeros(len(vocab) + 1, np.int64)
    for r in docs.select(text_col).mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect():
        out[r.word] = r.n
    return out, int(out[0])


def randomised_svd(rows: DataFrame, n_terms: int, rank: int, rounds: int = 2, seed: int = 23) -> tuple[np.ndarray, np.ndarray]:
    """Right singular vectors and values of a sparse matrix given as rows (terms array<int>, weights array<double>).

    A random block of ``rank`` + 8 directions is multiplied by A'A in each of
    ``rounds`` power rounds: tasks multiply their own rows and give partial
    products by blocks of terms, which are summed by a shuffle on the block. The
    driver sees matrices of vocabulary x rank alone.
    """
    r = np.random.default_rng(seed)
    k = min(n_terms, rank + 8)
    q = np.linalg.qr(r.normal(size=(n_terms, k)))[0]
    size = 512

    def product(q):
        def run(batches):
            out = np.zeros_like(q)
            for batch in batches:
                for t, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if t:
                        w = np.array(w)
                        out[t] += np.outer(w, w @ q[t])
            for b in range(0, len(q), size):
                if out[b : b + size].any():
                    yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([out[b : b + size].tobytes()], pa.binary())], ["block", "part"])

        def add(pdf):
            return pdf.head(1).assign(part=sum(np.frombuffer(p, np.float64) for p in pdf.part).tobytes())

        total = np.zeros_like(q)
        for x in rows.mapInArrow(run, "block int, part binary").groupBy("block").applyInPandas(add, "block int, part binary").collect():
            part = np.frombuffer(bytes(x.part), np.float64).reshape(-1, q.shape[1])
            total[x.block : x.block + len(part)] = part
        return total

    for _ in range(rounds):
        q = np.linalg.qr(product(q))[0]
    values, turn = np.linalg.eigh(q.T @ product(q))
    order = np.argsort(values)[::-1][:rank]
    return q @ turn[:, order], np.sqrt(np.maximum(values[order], 0))


@dataclass
class Corpus:
    """What the latent space takes from the documents: frequencies of the items' words over all of them, and a bounded sample of texts."""

    vocab: dict[bytes, int]
    seen: np.ndarray
    n_docs: int
    sample: DataFrame

    @classmethod
    def gather(cls, docs: DataFrame, vocab: dict[bytes, int], id_col: str, text_col: str, sample_docs: int) -> Corpus:
        """One pass counts; another draws about ``sample_docs`` texts of least id hash and at most 50,000 characters, and cuts them to few partitions."""
        seen, n_docs = _document_frequencies(docs, text_col, vocab)
        draw = F.shiftrightunsigned(F.xxhash64(F.lit("decontamination sample"), F.col(id_col)), 2)
        drawn = docs.where((draw < int(min(2**62, sample_docs / max(1, n_docs) * 2**62))) & (F.length(text_col) <= 50_000))
        return cls(vocab, seen, n_docs, cut(drawn.select(F.col(text_col).alias("text")).repartition(SAMPLE_PARTS)))


def build_index(items: list[tuple[int, str]], corpus: Corpus, rank: int) -> Index | None:
    """Fit the latent space of one block of items and place their passages in it.

    Document frequencies come from all documents. The SVD takes all passages of
    the items and the windows of the corpus' sample. Rows have unit length, those
    of the sample a tenth, so that the items shape the space.
    """
    split = [(i, t, passages(words(t))) for i, t in items if t and words(t)]
    if not split:
        return None
    vocab = {w: k + 1 for k, w in enumerate(sorted({w for _, _, ps in split for p in ps for w in p}))}
    seen = corpus.seen[[corpus.vocab[w] for w in vocab]]
    idf = np.concatenate(([0.0], np.log((corpus.n_docs + 1) / (seen + 1.0)) ** 1.5 + 1e-3))

    def weigh(p, scale=1.0):
        t, n = np.unique([vocab.get(w, 0) for w in p], return_counts=True)
        t, n = (t[1:], n[1:]) if len(t) and t[0] == 0 else (t, n)
        x = n * idf[t]
        return t.tolist(), (scale * x / max(1e-9, float(np.sqrt(x @ x)))).tolist()

    def rows_of(batches):
        for batch in batches:
            t, w = [], []
            for text in batch.column(0).to_pylist():
                ws = words(text)
                for i in range(0, len(ws), STRIDE * SPANS[-1]):
                    a, b = weigh(ws[i : i + STRIDE * SPANS[-1]], 0.1)
                    if len(a) >= 4:
                        t.append(a)
                        w.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.list_(pa.int32())), pa.array(w, pa.list_(pa.float64()))], ["terms", "weights"])

    own = [weigh(p) for _, _, ps in split for p in ps]
    kind = "terms array<int>, weights array<double>"
    table = cut(corpus.sample.sparkSession.createDataFrame(own, kind).coalesce(2).unionByName(corpus.sample.mapInArrow(rows_of, kind)))
    vectors, _ = randomised_svd(table, len(idf), rank)
    basis = (vectors * idf[:, None]).astype(np.float32)
    queries = np.array([sum(basis[vocab[w]] for w in p) for _, _, ps in split for p in ps], np.float32)
    queries /= np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), 1e-9)
    owner, masks, sizes, answers = [], [], [], []
    for k, (_, text, ps) in enumerate(split):
        for p in ps:
            bits: dict[bytes, int] = {}
            for at, w in enumerate(p):
                bits[w] = bits.get(w, 0) | 1 << at
            owner.append(k)
            masks.append(bits)
            sizes.append(len(p))
            answers.append(answer_words(text) if len(ps) == 1 else frozenset(p))
    return Index(vocab, idf, basis, queries, owner, masks, sizes, answers, [len(ps) for _, _, ps in split], [i for i, _, _ in split])


def mark_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    out_col: str = "contaminated_by",
    at_least: float = 0.4,
    verbatim: float = 0.8,
    paraphrase: float = 0.55,
    rank: int = 128,
    sample_docs: int = 1500,
    block_items: int = 1000,
) -> DataFrame:
    """Add ``out_col``: the benchmark items found in each whole text, with cosine, LCS share, answer share and word offset.

    The benchmark is the stated query set: its distinct items are taken in blocks
    of about ``block_items``, so that what is broadcast stays bounded. The texts
    are read once for the frequencies of the items' words and once for each block.
    A text is looked at in windows of 32, 48 and 64 words, one every 16, for
    passages of up to 17, 33 and 48 words; windows whose latent cosine with an
    item's passage is ``at_least`` are compared word by word, each by itself, and
    the best that passes is told. A window passes where the longest common
    subsequence covers ``verbatim`` of the passage, or ``paraphrase`` of it while
    the window holds half of the (weighted) words of the answer, its last sentence.
    Items of more than 48 words are cut in passages; half of them must be found,
    or one of them whole.

    With one block of items nothing of the texts is shuffled. With more, one block after the
    other is broadcast, gives the hits of texts that have some, keyed by 128-bit text hash, which are
    cut, and is freed, so that memory does not grow with their number; only rows in the hash
    buckets of such texts are shuffled to meet them.

    Null and empty texts and items are found nowhere, an empty table is an empty
    result. Repeated items are found alike; texts that share an item id are each held against a
    document by themselves, and the best of them is told. Repeated rows are each marked; all
    columns of ``docs`` are kept, and one that is named like ``out_col`` is an error.
    """
    if out_col.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"docs has a column {out_col}")
    python_batches(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text_col).alias("t")).where("i is not null and t is not null").distinct()
    items = cut(items.withColumn("block", F.pmod(F.xxhash64("i", "t"), F.lit(max(1, math.ceil(items.count() / block_items))))))
    every = {w for r in items.select("t").toLocalIterator() for w in words(r.t)}
    corpus = Corpus.gather(docs, {w: k + 1 for k, w in enumerate(sorted(every))}, id_col, text_col, sample_docs) if every else None
    kind = pa.list_(pa.struct([("item", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.float64()), ("answer", pa.float64()), ("start", pa.int32())]))

    def searched(df: DataFrame, shared, name: str) -> DataFrame:
        place = df.columns.index(text_col)

        def run(batches):
            for batch in batches:
                found = shared.value.hits(batch.column(place).to_pylist(), at_least, verbatim, paraphrase)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, name])

        return df.mapInArrow(run, widened(df, f"`{name}` {HITS}"))

    numbers = sorted(r.block for r in items.select("block").distinct().collect()) if every else []
    indexed = lambda b: build_index(sorted((r.i, r.t) for r in items.where(F.col("block") == b).collect()), corpus, rank)
    share = docs.sparkSession.sparkContext.broadcast
    if len(numbers) <= 1:
        index = indexed(numbers[0]) if numbers else None
        return searched(docs, share(index), out_col) if index else docs.withColumn(out_col, F.array().cast(HITS))
    h1, h2 = hash128(F.col(text_col))
    texts = docs.where(F.col(text_col).isNotNull()).select(h1.alias("h1"), h2.alias("h2"), text_col)
    some = []
    for b in numbers:
        if index := indexed(b):
            shared = share(index)
            some.append(cut(searched(texts, shared, "hits").where("size(hits) > 0").select("h1", "h2", F.explode("hits").alias("hit"))))
            shared.destroy()
    if not some:
        return docs.withColumn(out_col, F.array().cast(HITS))
    best = F.max_by("hit", F.struct("hit.lcs", "hit.cosine", "hit.answer", "hit.start"))
    told = reduce(DataFrame.union, some).groupBy("h1", "h2", "hit.item").agg(best.alias("hit")).groupBy("h1", "h2").agg(F.array_sort(F.collect_list("hit")).alias("hits"))
    return attach(docs, cut(told), [h1, h2], "hits", out_col, F.array().cast(HITS))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each benchmark item found in each document of ``documents``; null or empty texts have none."""
    marked = mark_contaminated(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return marked.select("doc_id", F.explode("contaminated_by").alias("hit")).select(
        "doc_id", F.col("hit.item").alias("item_id"), F.col("hit.cosine").alias("cosine"), F.col("hit.lcs").alias("lcs"), F.col("hit.answer").alias("answer"), F.col("hit.start").alias("start_word")
    )
