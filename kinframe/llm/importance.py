"""Operator 13: importance resampling of documents towards a target text distribution."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinframe.llm.common import LOWER, UPPER, cut, python_batches, read
from kinframe.operators.paging import positions

#: Reach of the position table: longer features are folded in blocks of so many bytes.
REACH = 64
#: Bytes of text, and of feature spans, that numpy looks at together; bounds a task's memory beside the texts themselves.
BLOCK = 1 << 20
#: Word bytes: digits, a to z (after A-Z became lower case) and everything beyond ASCII.
_WORD = np.zeros(256, np.bool_)
_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


def _position_table() -> tuple[np.ndarray, np.ndarray]:
    """(table, constants): what a byte adds to the checksum by its distance from the end of the feature, and what a length adds by itself.

    The checksum is linear over XOR: a byte's part is its part at the end, moved on by one
    zero byte for each byte that follows; the register's start and final inversion depend on the length alone.
    """
    table = np.zeros((REACH, 256), np.uint32)
    for b in range(256):
        c = b
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        table[0, b] = c
    zero = lambda reg: (reg >> np.uint32(8)) ^ table[0, reg & np.uint32(255)]
    for d in range(1, REACH):
        table[d] = zero(table[d - 1])
    start = np.array([0xFFFFFFFF], np.uint32)
    constants = [start[0]]
    for _ in range(REACH):
        start = zero(start)
        constants.append(start[0])
    return table, np.array(constants, np.uint32)


_TABLE, _STARTS = _position_table()


def _folded(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """XOR of the contributions of each span's bytes; spans of at most ``REACH`` bytes, none of them empty."""
    first = np.cumsum(size) - size
    within = np.arange(int(size.sum()), dtype=np.int64) - np.repeat(first, size)
    after = np.repeat(size, size) - 1 - within
    return np.bitwise_xor.reduceat(_TABLE[after, raw[np.repeat(start, size) + within]], first)


def span_checksums(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of ``raw`` (bytes), whatever its length."""
    out = np.zeros(len(start), np.uint32)
    total = np.cumsum(np.minimum(size, REACH))
    for a, b in _slices(total):
        s, n = start[a:b], size[a:b].astype(np.int64)
        head = np.where(n > REACH, n % REACH, n)  # a long span begins with what whole blocks leave over
        some = np.flatnonzero(head)
        reg = _STARTS[head]
        if len(some):
            reg[some] ^= _folded(raw, s[some], head[some])
        at, left = s + head, n - head
        more = np.flatnonzero(left)
        while len(more):
            moved = reg[more]
            folded = _folded(raw, at[more], np.full(len(more), REACH))
            for k in range(4):  # a register moves over a block as its four bytes would that stand at the block's start
                folded ^= _TABLE[REACH - 1 - k, (moved >> np.uint32(8 * k)) & np.uint32(255)]
            reg[more] = folded
            at[more] += REACH
            left[more] -= REACH
            more = more[left[more] > 0]
        out[a:b] = ~reg
    return out


def _slices(total: np.ndarray):
    """Slices of running totals that hold about ``BLOCK`` each, one element at least."""
    a = 0
    while a < len(total):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + BLOCK, "right")))
        yield a, b
        a = b


def words_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, size, words of each text) of the words of texts, A-Z lower-cased; no word crosses two texts."""
    raw = np.frombuffer(b"\0".join(texts).lower(), np.uint8)
    edge = np.zeros(len(raw) + 2, np.bool_)
    edge[1:-1] = _WORD[raw]
    edges = np.flatnonzero(edge[1:] != edge[:-1])
    start, size = edges[::2], edges[1::2] - edges[::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    before = np.searchsorted(start, ends)
    return raw, start, size, np.diff(before, prepend=0)


def feature_buckets(texts: list[bytes], most: int, buckets: int):
    """Per run length 1 to ``most``: (text of each feature, its bucket), features in order."""
    raw, start, size, n = words_of(texts)
    text = np.repeat(np.arange(len(texts)), n)
    yield text, span_checksums(raw, start, size) % np.uint32(buckets)
    if most > 1 and len(start):  # words side by side with one space between, so that a run is one span
        begin = np.cumsum(size + 1) - size - 1
        joined = np.full(int(begin[-1] + size[-1] + 1), 32, np.uint8)
        for a, b in _slices(np.cumsum(size)):
            within = np.arange(int(size[a:b].sum())) - np.repeat(np.cumsum(size[a:b]) - size[a:b], size[a:b])
            joined[np.repeat(begin[a:b], size[a:b]) + within] = raw[np.repeat(start[a:b], size[a:b]) + within]
        for k in range(2, most + 1):
            last = np.arange(k - 1, len(start))
            ok = last[text[last] == text[last - k + 1]] if len(last) else last
            first = ok - k + 1
            yield text[ok], span_checksums(joined, begin[first], begin[ok] + size[ok] - begin[first]) % np.uint32(buckets)


def _chunks(column: pa.Array):
    """(rows, texts) of a column, about ``BLOCK`` bytes at a time; a longer text is a chunk of its own. Null is empty."""
    texts = [t or b"" for t in column.cast(pa.binary()).to_pylist()]
    for a, b in _slices(np.cumsum([len(t) + 1 for t in texts])):
        yield a, texts[a:b]


def bucket_counts(df: DataFrame, text_col: str, most: int, buckets: int) -> DataFrame:
    """(bucket, n): how many features of all texts fall into each bucket that has any; counted in each task, then summed."""
    python_batches(df.sparkSession)

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, texts in _chunks(batch.column(0)):
                for _, bucket in feature_buckets(texts, most, buckets):
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(total[some])], ["bucket", "n"])

    return df.select(F.col(text_col).cast("string")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: dict[int, int], target: dict[int, int], buckets: int, scale: int = 1000) -> np.ndarray:
    """Per bucket the floored ``scale`` times log of its smoothed share in the target over that in the raw texts."""
    s_all, t_all = sum(raw.values()), sum(target.values())
    ratio = lambda k: (float(target.get(k, 0) + 1) * float(s_all + buckets)) / (float(raw.get(k, 0) + 1) * float(t_all + buckets))
    return np.array([math.floor(scale * math.log(ratio(k))) for k in range(buckets)], np.int64)


def gumbel(key: Column, scale: int = 1000) -> Column:
    """A floored Gumbel draw, fixed by ``key`` (text)."""
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-scale * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def importance_weights(docs: DataFrame, gain: np.ndarray, most: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of each row: ``weight`` is the floored mean of the gains of its features, 0 without any."""
    spark, buckets = docs.sparkSession, len(gain)
    python_batches(spark)
    shared = spark.sparkContext.broadcast(gain)

    def weigh(batches):
        for batch in batches:
            n = np.zeros((3, batch.num_rows), np.int64)  # words, features, gains
            for a, texts in _chunks(batch.column(1)):
                for k, (text, bucket) in enumerate(feature_buckets(texts, most, buckets)):
                    count = np.bincount(text, minlength=len(texts))
                    gained = np.concatenate(([0], np.cumsum(shared.value[bucket])))
                    ends = np.cumsum(count)
                    n[0, a : a + len(texts)] += count if k == 0 else 0
                    n[1, a : a + len(texts)] += count
                    n[2, a : a + len(texts)] += gained[ends] - gained[ends - count]
            weight = n[2] // np.maximum(n[1], 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, (n[0], n[1], weight))], ["id", "n_words", "n_features", "weight"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string")).mapInArrow(weigh, f"id {kind}, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    most: int = 1,
    buckets: int = 10_000,
    percent: int = 10,
    least_words: int = 20,
    seed: int = 2024,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_col: str = "text",
) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank): ``percent`` of the documents, drawn by how much likelier the target makes their features.

    Features are all runs of 1 to ``most`` words, hashed by CRC-32 into ``buckets``. A
    byte's contribution to the checksum depends on its value and its distance from the
    feature's end alone, so the checksums of all features of a block of text are one
    lookup in a table and one XOR over spans; longer features go block by block.
    Buckets are counted in tasks over all texts of both tables and summed; the driver
    gets one number for each bucket, which bounds it and the broadcast of the gains.
    ``score`` is weight plus a Gumbel draw fixed by seed and id, so the highest scores are
    a draw without replacement. Of the documents with ``least_words`` words, the
    floored share with the highest scores gets ranks (ties to the smaller id), by ranges
    of the order: no task sees all rows.

    Null and empty texts have no feature and weight 0. A null id draws as the text "null" and
    stands after all others of its score. Rows that repeat an id are rows of their own with
    one draw. Extra columns are not looked at. An empty table gives an empty result, an empty
    target leaves all buckets at the smoothed share.
    """
    counted = lambda df, c: {r.bucket: r.n for r in bucket_counts(df, c, most, buckets).collect()}
    gain = gains(counted(docs, text_col), counted(target, target_col), buckets)
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null")))
    scored = cut(importance_weights(docs, gain, most, id_col, text_col).withColumn("score", F.col("weight") + gumbel(key)))
    fit = F.col("n_words") >= least_words
    drawn = percent * scored.where(fit).count() // 100
    order = [fit.desc(), F.col("score").desc(), F.col("id").asc_nulls_last(), F.col("weight").desc(), F.col("n_features").asc()]
    placed = positions(scored, *order, out="place")
    rank = F.when(fit & (F.col("place") <= drawn), F.col("place"))
    return placed.select(F.col("id").alias(id_col), "n_words", "n_features", "weight", "score", rank.alias("rank"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten percent of ``documents`` drawn towards the texts of ``benchmark``; null and empty texts have no feature and are never drawn."""
    out = resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP13_SQL = rf"""
with recursive step(i, c, k) as (
  select i, i::bigint, 0 from range(256) t(i)
  union all
  select i, case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end, k + 1 from step where k < 8),
crc as (select list(c order by i) as t from step where k = 8),
d as (select doc_id, unnest({_WORDS}) as w from documents),
b as (select unnest({_WORDS}) as w from benchmark),
vocab as (select distinct w from (select w from d union all select w from b)),
hashed as (
  select w, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda h: ('0x' || h)::bigint)),
         lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295::bigint) % 10000 as bucket from vocab, crc),
s as (select bucket, count(*) as n from d join hashed using (w) group by bucket),
t as (select bucket, count(*) as n from b join hashed using (w) group by bucket),
gain as (
  select k.i as bucket, floor(1000 * ln(((coalesce(t.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from s) + 10000)::double)
         / ((coalesce(s.n, 0) + 1)::double * ((select coalesce(sum(n), 0) from t) + 10000)::double)))::bigint as g
  from range(10000) k(i) left join s on s.bucket = k.i left join t on t.bucket = k.i),
weighed as (select doc_id, count(*) as n, floor(sum(g)::double / count(*))::bigint as weight from d join hashed using (w) join gain using (bucket) group by doc_id),
scored as (
  select o.doc_id, coalesce(n, 0) as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || o.doc_id::varchar), 1, 8))::bigint + 0.5::double) / 4294967296::double)))::bigint as score
  from documents o left join weighed using (doc_id)),
ranked as (select doc_id, row_number() over (order by score desc, doc_id) as r from scored where n_features >= 20)
select doc_id, n_features::bigint as n_features, weight, score, case when r <= (select 10 * count(*) // 100 from ranked) then r end::bigint as rank
from scored left join ranked using (doc_id)
"""
