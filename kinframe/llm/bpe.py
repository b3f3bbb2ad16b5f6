"""Operator 7: byte-level BPE encoding and decoding over a public rank file."""

from __future__ import annotations

import base64
import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from kinframe.llm.common import Remembered, python_batches, read

_NONE = np.int64(2**62)
_LOW = np.int64(2**32 - 1)
#: Words up to this many bytes are merged side by side in numpy; longer ones one by one.
SIDE_BY_SIDE = 64


def pair_table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens whose join is a token: sorted keys (left rank, right rank) and the rank of each."""
    ranks = {t: i for i, t in enumerate(tokens) if t is not None}
    found = {}
    for token, rank in ranks.items():
        for cut in range(1, len(token)):
            a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
            if a is not None and b is not None:
                found[a << 32 | b] = rank
    keys = np.fromiter(sorted(found), np.int64, len(found))
    return keys, np.fromiter((found[k] for k in keys.tolist()), np.int64, len(keys))


@dataclass
class Vocabulary:
    """Tokens by rank, which is a token's id, and the pairs that merge. One for each task, freed with it."""

    tokens: list[bytes]
    pattern: str
    keys: np.ndarray
    values: np.ndarray
    ranks: dict[bytes, int] = field(init=False)
    single: np.ndarray = field(init=False)

    def __post_init__(self):
        self.numbers = list(range(len(self.tokens)))  # so that equal ids are one object
        self.ranks = {t: i for t, i in zip(self.tokens, self.numbers) if t is not None}
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.split = regex.compile(self.pattern).findall
        self.memory = Remembered()

    @classmethod
    def of(cls, rank_file: str, pattern: str) -> Vocabulary:
        tokens = load_ranks(rank_file)
        return cls(tokens, pattern, *pair_table(tokens))

    def rank(self, a: int, b: int) -> int | None:
        """Rank of one joined pair."""
        want = a << 32 | b
        at = int(np.searchsorted(self.keys, want))
        return int(self.values[at]) if at < len(self.keys) and self.keys[at] == want else None

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each joined pair, ``_NONE`` where the join is no token."""
        want = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.values[at], _NONE)


def load_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file by rank (base64 token, blank, rank on each line)."""
    pairs = [line.split() for line in open(path, "rb") if line.strip()]
    tokens: list = [None] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


def merge_long(word: bytes, v: Vocabulary) -> tuple[int, ...]:
    """Merge one word by a segment tree over its byte positions.

    Leaf i holds the rank of the pair that begins at position i, and an inner
    node the least (rank, position) below it, so the root is the leftmost pair of
    least rank. A merge changes the pairs of two live neighbours and removes one
    position: three leaf updates of logarithmic cost.
    """
    n = len(word)
    token = [int(v.single[b]) for b in word]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    size = 1 << max(0, n - 1).bit_length()
    tree = [int(_NONE)] * (2 * size)
    none = int(_NONE)

    def leaf(i: int) -> int:
        rank = v.rank(token[i], token[after[i]]) if after[i] < n else None
        return none if rank is None else rank << 32 | i

    first = v.pair_ranks(np.array(token[:-1]), np.array(token[1:]))
    tree[size : size + n - 1] = np.where(first < _NONE, first << 32 | np.arange(n - 1), _NONE).tolist()
    for x in range(size - 1, 0, -1):
        tree[x] = min(tree[2 * x], tree[2 * x + 1])

    def update(i: int, value: int) -> None:
        x = size + i
        tree[x] = value
        x >>= 1
        while x:
            least = min(tree[2 * x], tree[2 * x + 1])
            if tree[x] == least:
                break
            tree[x] = least
            x >>= 1

    while tree[1] < none:
        i = tree[1] & 0xFFFFFFFF
        token[i] = tree[1] >> 32
        gone = after[i]
        after[i] = after[gone]
        if after[i] < n:
            before[after[i]] = i
        update(gone, none)
        update(i, leaf(i))
        if before[i] >= 0:
            update(before[i], leaf(before[i]))
    out, i = [], 0
    while i < n:
        out.append(token[i])
        i = after[i]
    return tuple(out)


def merge_many(words: list[bytes], v: Vocabulary) -> list[tuple[int, ...]]:
    """The same trees for many short words at once: one numpy row each, one merge in every live row a step."""
    out: list = [None] * len(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    for size in (2, 4, 8, 16, 32, SIDE_BY_SIDE):
        rows = np.flatnonzero((lengths > size // 2) & (lengths <= size)) if size > 2 else np.flatnonzero(lengths <= 2)
        for part in np.array_split(rows, max(1, len(rows) * size // 262_144)):
            if len(part):
                _merge_rows([words[i] for i in part], lengths[part], size, v, out, part)
    return out


def _merge_rows(words, n, size, v, out, place) -> None:
    w = len(words)
    raw = np.frombuffer(b"".join(x.ljust(size, b"\0") for x in words), np.uint8).reshape(w, size)
    token = v.single[raw]
    at = np.arange(size, dtype=np.int64)
    after = np.tile(at + 1, (w, 1))
    before = np.tile(at - 1, (w, 1))
    tree = np.full((w, 2 * size), _NONE, np.int64)
    ranks = v.pair_ranks(token[:, :-1], token[:, 1:])
    tree[:, size : 2 * size - 1] = np.where((at[:-1] + 1 < n[:, None]) & (ranks < _NONE), ranks << 32 | at[:-1], _NONE)
    x = size
    while x > 1:
        tree[:, x // 2 : x] = np.minimum(tree[:, x : 2 * x : 2], tree[:, x + 1 : 2 * x : 2])
        x //= 2
    live = np.flatnonzero(tree[:, 1] < _NONE)

    def update(r, i, value):
        node = size + i
        tree[r, node] = value
        node >>= 1
        while node[0]:
            tree[r, node] = np.minimum(tree[r, 2 * node], tree[r, 2 * node + 1])
            node >>= 1

    def refresh(r, i):
        j = after[r, i]
        inside = j < n[r]
        rank = v.pair_ranks(token[r, i], token[r, np.where(inside, j, 0)])
        update(r, i, np.where(inside & (rank < _NONE), rank << 32 | i, _NONE))

    alive = np.zeros((w, size), bool)
    alive[at < n[:, None]] = True
    while len(live):
        root = tree[live, 1]
        i = root & _LOW
        token[live, i] = root >> 32
        gone = after[live, i]
        alive[live, gone] = False
        following = after[live, gone]
        after[live, i] = following
        inner = following < n[live]
        before[live[inner], following[inner]] = i[inner]
        update(live, gone, _NONE)
        refresh(live, i)
        p = before[live, i]
        left = p >= 0
        if left.any():
            refresh(live[left], p[left])
        live = live[tree[live, 1] < _NONE]
    for k, t, a in zip(place.tolist(), token, alive):
        out[k] = tuple(map(v.numbers.__getitem__, t[a].tolist()))


def encode_batch(texts: list[str], v: Vocabulary) -> list[list[int]]:
    """Token ids of each text; words seen before come from the task's bounded memory."""
    memory, split = v.memory, [v.split(t) for t in texts]
    fresh = memory.unknown({x for s in split for x in s})
    short_text, short = [], []
    for x in fresh:
        raw = x.encode()
        rank = v.ranks.get(raw)
        if rank is not None:  # a word that is itself a token is that token
            memory[x] = (rank,)
        elif len(raw) > SIDE_BY_SIDE:
            memory[x] = merge_long(raw, v)
        else:
            short_text.append(x)
            short.append(raw)
    memory.update(zip(short_text, merge_many(short, v)))
    return [[i for x in s for i in memory[x]] for s in split]


def decode(ids: list[int], v: Vocabulary) -> bytes:
    return b"".join(map(v.tokens.__getitem__, ids))


def encode_documents(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text; returns (id, ids array<int>, decoded binary).

    The rank file is read where the job is planned; its tokens and their pairs (a
    fixed file, some MB) are broadcast; the pattern cuts a text into words and each
    word is merged by a segment tree of pair ranks. One pass, no shuffle. Null and
    empty texts have no tokens. Rows and ids may repeat or be null; each row is
    encoded; an empty table gives an empty result. Other columns are not looked
    at. Arrow batches are kept small in rows and bytes, the words that a task
    remembers by bytes, and both are freed with its partition.
    """
    spark = docs.sparkSession
    python_batches(spark)
    shared = spark.sparkContext.broadcast((tokens := load_ranks(rank_file), pattern, *pair_table(tokens)))

    def run(batches):
        v = Vocabulary(*shared.value)  # this task's own, freed with it
        for batch in batches:
            ids = encode_batch([t or "" for t in batch.column(1).to_pylist()], v)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([decode(x, v) for x in ids], pa.binary())], ["id", "ids", "decoded"]
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, ids array<int>, decoded binary").withColumnRenamed("id", id_col)


def digests(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of :func:`encode_documents`, hashed where the ids are made."""
    spark = docs.sparkSession
    python_batches(spark)
    shared = spark.sparkContext.broadcast((tokens := load_ranks(rank_file), pattern, *pair_table(tokens)))

    def run(batches):
        v = Vocabulary(*shared.value)  # this task's own, freed with it
        text = list(map(str, range(len(v.tokens))))
        for batch in batches:
            n, a, b = [], [], []
            for ids in encode_batch([t or "" for t in batch.column(1).to_pylist()], v):
                n.append(len(ids))
                a.append(hashlib.sha256(",".join(map(text.__getitem__, ids)).encode()).hexdigest())
                b.append(hashlib.sha256(decode(ids, v)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document of ``documents``; null and empty texts have no token."""
    import public_tokenizers

    return digests(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
