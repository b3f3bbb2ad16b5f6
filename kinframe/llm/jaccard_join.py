"""Operator 8: n-gram Jaccard join by parity sketches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinframe.llm.common import connected_components, cut, fitted, only, python_batches, read, without

_MIX = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def _scramble(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _MIX[0]
    return (h ^ (h >> np.uint64(29))) * _MIX[1]


#: Words longer than so many eight-byte pieces are hashed one by one.
PIECES = 8
_UNUSED = np.array([0, 56, 48, 40, 32, 24, 16, 8, 0], np.uint64)  # bits of a piece beyond so many bytes


def word_hashes(raw: bytes) -> np.ndarray:
    """64-bit hashes of the words of ``raw``, in order: eight bytes of all words at a time, then the length."""
    if not raw:
        return np.zeros(0, np.uint64)
    byte, edge = np.frombuffer(raw, np.uint8), np.zeros(len(raw) + 2, np.bool_)
    edge[1:-1] = (byte != 32) & (byte - np.uint8(9) > 4)  # no ASCII white space: neither 32 nor 9 to 13
    edges = np.flatnonzero(edge[1:] != edge[:-1])
    start, size = edges[::2], edges[1::2] - edges[::2]
    piece = np.ndarray(len(raw), "<u8", raw + bytes(8), strides=(1,))  # the eight bytes from each place on
    h, rest, at, left = size.astype(np.uint64), None, start, size
    for _ in range(PIECES):
        bits = _UNUSED[np.minimum(left, 8)]
        mixed = _scramble((h if rest is None else h[rest]) * _MIX[2] + ((piece[at] << bits) >> bits))
        if rest is None:
            h = mixed
        else:
            h[rest] = mixed
        more = np.flatnonzero(left > 8)
        rest, at, left = more if rest is None else rest[more], at[more] + 8, left[more] - 8
        if not len(rest):
            return h
    for i in rest.tolist():
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : start[i] + size[i]])
    return h


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles of a whole text.

    Words are the runs between ASCII white space, A-Z lower-cased. Fewer words
    than ``n`` make one shingle of the whole sequence; no word makes none.
    """
    w = word_hashes(text.encode().lower()) if text else _MIX[:0]
    if not len(w):
        return np.zeros(0, np.uint64)
    k = min(n, len(w))
    h = np.full(len(w) - k + 1, k, np.uint64)
    for j in range(k):
        h *= _MIX[3]
        h += w[j : len(w) - k + 1 + j]
    h = _scramble(h)
    h.sort()
    return h[np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))]


def band(size: int, percent: int) -> int:
    """Size band; bands are as wide as twice the step from a set to the largest one similar to it."""
    return int(np.log(size) / (-2 * np.log(percent / 100)) + 1e-9)


def _largest(b: int, percent: int) -> int:
    """No set of band ``b`` is larger."""
    return int((100 / percent) ** (2 * (b + 1)) + 1e-6) + 1


def bands(size: int, percent: int) -> list[int]:
    """Bands in which a set meets others: its own, and the one below if a set of that one can be similar to it."""
    b = band(size, percent)
    return [b, b - 1] if b > 0 and size * percent <= 100 * _largest(b - 1, percent) else [b]


def shape(b: int, percent: int) -> tuple[int, int]:
    """Words of a sketch of band ``b``, and how many equal words a similar pair of that band has at least.

    In a pair whose smaller set is of band ``b`` there are at most ``d``
    differences, which touch at most ``d`` words: of ``d`` + k words k are equal.
    """
    small = _largest(b, percent)
    d = (small + small * 100 // percent) * (100 - percent) // (100 + percent)
    equal = 2 + d // 8
    return (d + equal + d // 16 + 1, equal) if d else (1, 1)


def words_of(h: np.ndarray, b: int, percent: int) -> np.ndarray:
    """The words of the sketch of a set for band ``b``: each is the parity, bit by bit, of the hashes of the elements dealt to it.

    A difference of two sets touches one word.
    """
    n = shape(b, percent)[0]
    word = ((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)  # h is sorted, so words come in order
    at = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1])))
    words = np.zeros(n, np.uint64)
    words[word[at].astype(np.int64)] = np.bitwise_xor.reduceat(_scramble(h), at)
    return words


def most_apart(size: int, b: int, percent: int) -> int:
    """No set that is similar to one of ``size`` differs from it in more elements, where the smaller of the two is of band ``b``."""
    other = min(size, _largest(b, percent))
    return (size + (other if other < size else size * 100 // percent)) * (100 - percent) // (100 + percent)


def join_keys(h: np.ndarray, percent: int) -> np.ndarray:
    """Keys under which a set meets all sets similar enough, as often as :func:`shape` says.

    Of its words a set gives the first ``most_apart`` + k in an order common to
    all sets (by key, empty words last): of two sets of which at most that many
    words differ, the first so many of each have k in common.
    """
    out = []
    for b in bands(len(h), percent):
        words = words_of(h, b, percent)
        keys, empty = _scramble(words + _scramble(np.arange(len(words), dtype=np.uint64) + np.uint64(b << 32))), words == 0
        first = most_apart(len(h), b, percent) + shape(b, percent)[1]
        keys = np.concatenate((np.sort(keys[~empty]), np.sort(keys[empty]))) if first > np.count_nonzero(words) else np.sort(keys[~empty])
        out.append(keys[:first])
    return np.concatenate(out)


#: Bits of the short sketch that every text has, and of that of texts with more than ``LONG`` shingles.
SHORT, SHORT_OF_LONG, LONG = 2048, 32768, 2500


def short_sketch(h: np.ndarray) -> list[int]:
    """A parity sketch of one size for all bands, as 64-bit words; its Hamming distance bounds the difference from below too."""
    bits = SHORT_OF_LONG if len(h) > LONG else SHORT
    odd = np.bincount((h & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def folded(bits: np.ndarray) -> np.ndarray:
    """Sketches of any size as those of ``SHORT`` bits."""
    return np.bitwise_xor.reduce(bits.reshape(*bits.shape[:-1], -1, SHORT // 64), axis=-2)


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def _texts_of(ids: DataFrame, base: DataFrame) -> DataFrame:
    """(id, text) of the ``ids`` alone, one text each."""
    return only(base, ids, "id").groupBy("id").agg(F.min("text").alias("text"))


def _verify(pairs: DataFrame, base: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough, by exact comparison of whole texts."""
    pairs = fitted(cut(pairs))
    texts = _texts_of(fitted(cut(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())), base)
    left = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")

    def run(batches):
        for batch in batches:
            sets: dict[str, np.ndarray] = {}
            keep = []
            for ta, tb in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                for t in (ta, tb):
                    if t not in sets:
                        sets[t] = shingles(t, n)
                keep.append(similar(sets[ta], sets[tb], percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def similar_components(docs: DataFrame, n: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", leader_rounds: int = 1, block: int = 2000) -> DataFrame:
    """(id, n_shingles, component): components of the graph of texts with Jaccard similarity of ``percent`` or more.

    1. Each text gives its shingle set and a 128-bit digest of it. Texts of one
       digest are one class, met by partial aggregation; only the least id of a
       class goes on, and gives the join keys of its parity sketches.
    2. Keys are shuffled once; a window keeps those met twice. In each bucket (a key)
       every set is paired with the bucket's leader, its least id: a star instead of
       all pairs. Keys that very many sets hold are told beforehand from a bounded
       sample, which also gives their leaders; they are dealt over many tasks. (The
       sample shapes the tasks and the choice of leaders, not the result.) Of each set
       the pair that met most often is verified exactly on whole texts, and linked
       sets joined to components.
    3. Buckets that still hold several components give their pairs at once where
       they have a handful of members (a similar pair has more equal words than
       a chance one, which is told by counting); all pairs must also pass by a
       short sketch of fixed size before texts are read; larger ones get new random leaders (by
       a hash of the id, so that buckets of one group share them) for the members outside the leader's component, ``leader_rounds`` times.
    4. What is left of the larger ones is compared exactly: the members of a
       bucket outside its largest component against all, in blocks of ``block``
       rows, first by short sketch (the Hamming distance bounds the difference from
       below), then by text. A pair that shares many buckets is given by the one of
       least key alone. No partner and no bucket is capped.

    Null texts and texts without a word have no shingles and stay alone. Ids must
    be integers. Rows of null id are returned with a null component and link with
    nothing. Rows that repeat an id are one document, which links by any of its
    texts; each row is returned. An empty table gives an empty result. Extra columns
    are not looked at.
    """
    spark = docs.sparkSession
    python_batches(spark)
    every = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    base = every.where("id is not null")

    def digested(batches):
        for batch in batches:
            sets = [shingles(t, n) for t in batch.column(1).to_pylist()]
            digest = [xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None for h in sets]
            need = [shape(band(len(h), percent), percent)[1] if len(h) else 0 for h in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array(digest, pa.binary()), pa.array(need, pa.int32()), pa.array(map(short_sketch, sets), pa.list_(pa.int64()))], ["id", "n", "digest", "need", "short"])

    def keys_of(batches):
        for batch in batches:
            ids, keys = batch.column(0).to_numpy(), [join_keys(h, percent) if len(h) else np.zeros(0, np.uint64) for h in (shingles(t, n) for t in batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.repeat(ids, list(map(len, keys))))], ["key", "id"])

    sized = cut(every.mapInArrow(digested, "id long, n long, digest binary, need int, short array<long>"))
    sizes = sized.where("id is not null")
    none = F.coalesce("digest", F.lit(b""))
    repeated = cut(sizes.groupBy("id").agg(F.min(none).alias("lo"), F.max(none).alias("hi")).where("lo <> hi").select("id"))
    if not repeated.isEmpty():
        return _with_repeated_ids(every, repeated, n, percent, leader_rounds, block).withColumnRenamed("id", id_col)
    classes = sizes.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"))
    members = cut(sizes.where("digest is not null").select("id", "digest").join(classes, "digest").select("id", "rep"))
    copies = members.where("id <> rep").select("id").distinct()
    own = without(base, copies, "id")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("leaders"), "id"), 2) < int(min(2**62, SAMPLE / max(1, classes.count()) * 2**62))
    led = own.where(draw).mapInArrow(keys_of, "key long, id long").groupBy("key").agg(F.countDistinct("id").alias("c"), F.min("id").alias("leader"))
    led = F.broadcast(cut(led.where(F.col("c") >= HEAVY).select("key", "leader")))
    keyed = own.mapInArrow(keys_of, "key long, id long").join(led, "key", "left")
    here = Window.partitionBy("key", "part")
    parted = keyed.withColumn("part", F.when(F.col("leader").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.lit("part"), "id"), F.lit(1024)).cast("int")))
    met = parted.select("key", "id", "leader", F.min("id").over(here).alias("a"), F.max("id").over(here).alias("z"))
    buckets = cut(met.where("leader is not null or a <> z").select("key", "id", F.coalesce("leader", "a").alias("a")))
    length = sizes.groupBy("id").agg(F.max("n").alias("n"), F.max("need").alias("need"))

    def fit(pairs: DataFrame, floor: Column, best: bool = False) -> DataFrame:
        """Pairs (a, b) of near enough sizes and short sketches that are ``sure`` or met in as many buckets as ``floor`` says; of each b the ``best`` met alone."""
        met = pairs.groupBy("a", "b").agg(F.count("*").alias("met"), F.max("sure").alias("sure"))
        if best:
            met = met.groupBy("b").agg(F.max(F.struct("met", (-F.col("a")).alias("minus"), "sure")).alias("x")).select((-F.col("x.minus")).alias("a"), "b", "x.met", "x.sure")
        sized = met.join(length.toDF("a", "na", "ka"), "a").join(length.toDF("b", "nb", "kb"), "b")
        sized = cut(sized.where((F.col("sure") | (F.col("met") >= floor)) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)).select("a", "b", "na", "nb"))
        sized = fitted(sized)
        left = fitted(cut(sized.select(F.explode(F.array("a", "b")).alias("id")).distinct()))
        short = only(sizes.select("id", "short"), left, "id").groupBy("id").agg(F.min("short").alias("short"))
        both = sized.join(short.toDF("a", "sa"), "a").join(short.toDF("b", "sb"), "b")
        far = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
        far = F.when(F.size("sa") == F.size("sb"), far).otherwise(0)  # sketches of two sizes rule out nothing
        return both.where(far * (100 + percent) <= (F.col("na") + F.col("nb")) * (100 - percent)).select("a", "b")

    smaller = F.when(F.col("na") <= F.col("nb"), F.col("ka")).otherwise(F.col("kb"))
    links = cut(_verify(fit(buckets.where("a <> id").select("a", F.col("id").alias("b"), F.lit(False).alias("sure")), F.least(smaller, F.lit(2)), best=True), base, n, percent))
    buckets = buckets.select("key", "id")
    for turn in range(leader_rounds + 1):
        comp = connected_components(links)
        known = buckets.join(comp.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
        mixed = known.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("total")).where("lo <> hi").select("key", "total")
        open_ = fitted(cut(known.join(fitted(cut(mixed)), "key")))  # both sides as they are, so that a large bucket can be split
        ordered = lambda p, sure: p.select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"), F.lit(sure).alias("sure"))
        if turn < leader_rounds:
            draw = F.struct(F.xxhash64(F.lit(turn), "id").alias("h"), "id", "component")  # alike in all buckets, so that a group has few leaders
            heads = open_.where(F.col("total") > SMALL).groupBy("key").agg(F.min(draw).alias("head")).select("key", "head.id", "head.component").toDF("key", "a", "head_component")
            heads = fitted(cut(heads))
            pairs = ordered(open_.join(heads, "key").where("component <> head_component").select("a", "id"), True)
        else:
            pairs = ordered(_open_pairs(open_, sizes, percent, block), True)
        if turn == 0:  # a pair that meets in no larger bucket must meet in enough small ones
            pairs = pairs.union(ordered(_small_pairs(open_), False))
        pairs = fit(pairs, smaller)
        links = fitted(cut(links.union(_verify(pairs, base, n, percent)).distinct()))
        buckets = open_.where(F.col("total") > SMALL).select("key", "id")
    comp = connected_components(links.union(members.where("id <> rep").select(F.col("rep").alias("a"), F.col("id").alias("b"))))
    placed = sizes.select("id", "n").join(comp.withColumnRenamed("node", "id"), "id", "left").select("id", "n", F.coalesce("component", "id").alias("component"))
    return placed.union(sized.where("id is null").select("id", "n", "id")).toDF(id_col, "n_shingles", "component")


def _with_repeated_ids(rows: DataFrame, repeated: DataFrame, n: int, percent: int, leader_rounds: int, block: int) -> DataFrame:
    """The components where ids of ``repeated`` have several texts: each text is a row of its own, then rows of one id are one."""
    marked = rows.join(repeated.withColumn("several", F.lit(True)), "id", "left")
    marked = marked.withColumn("row", F.when(F.col("several"), F.xxhash64(F.lit("row"), "id", "text")).otherwise(F.col("id")))
    found = similar_components(marked.select("row", "text"), n, percent, "row", "text", leader_rounds, block)
    found = cut(found.join(marked.where("id is not null").select("row", "id").distinct(), "row", "left"))
    known = found.where("id is not null")
    least = cut(known.groupBy("id").agg(F.min("component").alias("a")))
    one = connected_components(known.join(least, "id").select("a", F.col("component").alias("b")).where("a <> b").distinct()).toDF("component", "label")
    labelled = known.join(one, "component", "left").withColumn("label", F.coalesce("label", "component"))
    named = cut(labelled.groupBy("label").agg(F.min("id").alias("component")))
    out = labelled.drop("component").join(named, "label").select("id", "n_shingles", "component")
    return out.union(found.where("id is null").select("id", "n_shingles", "id"))


#: Sets of the sample that tells which keys very many sets hold, and how many of them make a key one of those.
SAMPLE, HEAVY = 10_000, 20
#: Buckets of up to so many members give their few pairs at once.
SMALL = 8
#: Least keys of a set that go with it to its blocks; a pair with none of these in common is given by each bucket it shares.
FIRST_KEYS = 64


def _small_pairs(open_: DataFrame) -> DataFrame:
    """Pairs (a, id) of different components in buckets of at most ``SMALL`` members."""
    few = open_.where(F.col("total") <= SMALL).groupBy("key").agg(F.collect_list(F.struct("id", "component")).alias("m"))
    one = few.select(F.explode("m").alias("x"), "m").select("x", F.explode("m").alias("y"))
    return one.where((F.col("x.id") < F.col("y.id")) & (F.col("x.component") != F.col("y.component"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("id"))


def _open_pairs(open_: DataFrame, sizes: DataFrame, percent: int, block: int) -> DataFrame:
    """Pairs (a, id) of different components that share a bucket and whose short sketches allow the similarity.

    The members outside a bucket's largest component meet all of its members,
    as pairs of blocks, so that a task looks at about two blocks at a time. Members
    of different components meet in every open bucket they share; only that of the
    least key among the ``FIRST_KEYS`` of both gives the pair.
    """
    counts = open_.groupBy("key", "component").agg(F.count("*").alias("c"))
    shape = counts.groupBy("key").agg(F.max(F.struct("c", "component")).alias("top"), F.sum("c").alias("total")).select(
        "key", F.col("top.component").alias("top"), F.ceil(F.col("total") / block).cast("int").alias("columns"), F.ceil((F.col("total") - F.col("top.c")) / block).cast("int").alias("rows"))
    placed = open_.select("key", "id", "component").join(cut(shape), "key").withColumn("h", F.xxhash64(F.lit("block"), "id"))
    placed = placed.select("key", "id", "component", (F.col("component") != F.col("top")).alias("other"), "rows", "columns", F.pmod("h", "rows").cast("int").alias("row"), F.pmod("h", "columns").cast("int").alias("column"))
    across = F.transform(F.sequence(F.lit(0), F.col("columns") - 1), lambda j: F.struct(F.col("row").alias("i"), j.alias("j")))
    down = F.transform(F.sequence(F.lit(0), F.col("rows") - 1), lambda i: F.struct(i.alias("i"), F.col("column").alias("j")))
    cells = placed.withColumn("cell", F.explode(F.when(F.col("other"), F.array_union(across, down)).otherwise(down)))  # once where it is both probe and met
    cells = cells.select("key", "id", "component", (F.col("other") & (F.col("cell.i") == F.col("row"))).alias("probe"), (F.col("cell.j") == F.col("column")).alias("met"), "cell.i", "cell.j")

    sketches = only(sizes.select("id", "n", "short"), open_.select("id").distinct(), "id").groupBy("id").agg(F.max("n").alias("n"), F.min("short").alias("short"))
    firsts = open_.groupBy("id").agg(F.slice(F.sort_array(F.collect_set("key")), 1, FIRST_KEYS).alias("firsts"))
    dealt = cells.join(sketches.join(firsts, "id"), "id").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def near_pairs(bucket: int, group: list[tuple]) -> set[tuple[int, int]]:
        at: dict[int, list[tuple]] = {}
        firsts = {row[1]: frozenset(row[-1]) for row in group}
        for g, x, probe, met, size, short, _ in group:  # by length of the sketch
            if met:
                at.setdefault(len(short), []).append((x, g, size, short))
        stacked = [tuple(np.array(c) for c in zip(*rows)) for rows in at.values()]
        found = set()
        for g, x, probe, met, size, short, _ in group:
            if probe:
                mine = np.array(short)
                for ids, of, sizes, bits in stacked:
                    apart = bits ^ mine if bits.shape[1] == len(mine) else folded(bits) ^ folded(mine)
                    far = np.bitwise_count(apart.view(np.uint64)).sum(axis=1, dtype=np.int64)  # of signed numbers it would count the absolute values
                    ok = (far * (100 + percent) <= (sizes + size) * (100 - percent)) & (of != g)
                    found.update((x, y) for y in ids[ok].tolist() if min(firsts[x] & firsts[y], default=bucket) == bucket)
        return found

    def compare(batches):
        kind = pa.schema([("a", pa.int64()), ("id", pa.int64())])
        out = lambda found: pa.RecordBatch.from_pylist([{"a": a, "id": b} for a, b in sorted(found)], kind)
        here, group = None, []
        for batch in batches:
            key, i, j, *rest = (batch.column(c).to_pylist() for c in ("key", "i", "j", "component", "id", "probe", "met", "n", "short", "firsts"))
            for k, row in zip(zip(key, i, j), zip(*rest)):
                if k != here:
                    if group:
                        yield out(near_pairs(here[0], group))
                    here, group = k, []
                group.append(row)
        if group:
            yield out(near_pairs(here[0], group))

    return dealt.mapInArrow(compare, "a long, id long")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three-word shingles, similarity 0.9, over every document of ``documents``; null and wordless texts are alone."""
    out = similar_components(read(spark, sf_dir, "documents"), n=3, percent=90)
    return out.select("doc_id", "n_shingles", F.col("component").alias("component_id"))
