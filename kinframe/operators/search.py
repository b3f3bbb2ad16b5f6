"""Text search, vector search, and candidates for duplicates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from kinframe.operators import paging
from kinframe.plans.checkpoints import beside, cut


def tokens(text: Column) -> Column:
    """Lower-cased words of letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def inverted_index(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, id, tf): one row per distinct word of a document; write it once and search it often."""
    return docs.select(F.col(id_col).alias("id"), F.explode(tokens(F.col(text_col))).alias("term")).groupBy("term", "id").agg(F.count("*").alias("tf"))


def search(index: DataFrame, n_docs: int, queries: DataFrame) -> DataFrame:
    """(query_id, id, score): documents with all words of a query, scored by the sum of tf x idf.

    ``queries`` is (query_id, text). The postings of a query's rarest word are its
    candidates; the other words only meet those, by word and document, so that a
    word of very many documents neither multiplies rows nor fills one task.
    """
    words = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    need = words.groupBy("query_id").agg(F.count("*").alias("need"))
    wanted = index.join(words.select("term").distinct(), "term", "left_semi")
    df = wanted.groupBy("term").agg(F.count("*").alias("df"))
    known = words.join(df, "term")
    rarest = known.groupBy("query_id").agg(F.count("*").alias("there"), F.min(F.struct("df", "term")).alias("r")).join(need, "query_id").where("there = need")
    candidates = rarest.select("query_id", "need", F.col("r.term").alias("term")).join(wanted, "term").select("query_id", "need", "id")
    hits = candidates.join(known, "query_id").join(wanted, ["term", "id"])
    scored = hits.groupBy("query_id", "id", "need").agg(F.count("*").alias("met"), F.sum(F.col("tf") * F.log(F.lit(float(n_docs)) / F.col("df"))).alias("score"))
    return scored.where("met = need").select("query_id", "id", "score")


def search_records(texts: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, type, handle, score): search over records of all types at once.

    ``texts`` is (type, handle, text), ``queries`` (query_id, text, type); a query
    with a type finds records of that one alone, scored by the counts of all.
    """
    keyed = texts.select(F.struct("type", "handle").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    found = search(inverted_index(keyed, "id", "text"), texts.count(), queries.select("query_id", "text"))
    return found.join(queries.select("query_id", F.col("type").alias("__only")), "query_id").where("__only is null or __only = id.type").select("query_id", "id.type", "id.handle", "score")


def placed(found: DataFrame, changes: DataFrame, keys: str = "-score") -> DataFrame:
    """``found`` of :func:`search_records` with ``change`` and each hit's ``place`` (from 1) in its query, in the order of ``keys``.

    ``changes`` is (type, handle, change); ``keys`` is a comma list of ``score``, ``change`` and ``type``, with ``-`` for
    descending; type and handle break ties. A record without a change has null there. The hits of all queries are put in
    one order by ranges, so that a query with very many hits does not fill one task.
    """
    dated = found.join(changes.select("type", "handle", "change"), ["type", "handle"], "left")
    order = paging.sort_columns(keys, {k: F.col(k) for k in ("score", "change", "type")})
    at = paging.positions(dated, F.col("query_id"), *order[:-1], F.col("type"), F.col("handle"), out="__at")
    first = at.groupBy("query_id").agg(F.min("__at").alias("__first"))
    return at.join(first, "query_id").select("query_id", "type", "handle", "score", "change", (F.col("__at") - F.col("__first") + 1).alias("place"))


def semantic_topk(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", block: int = 8192, stripe: int = 16_384) -> DataFrame:
    """(query_id, id, cosine, place): the ``k`` nearest vectors of each query by cosine, of equal ones those of least id.

    ``queries`` (query_id, vector) is the stated set and meets every row of its length: blocks of
    queries and stripes of rows meet in tiles, by a matrix product that finds the rows close to
    the best ``k``; those are scored in double precision, one component after the other,
    and the best of all tiles are ranked. Vectors that are null or hold a null take no part; the cosine
    with a zero vector is NaN, which comes first, as in SQL.
    """
    whole = lambda c: F.coalesce(~F.exists(c, lambda x: x.isNull()), F.lit(False))
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where(whole("v"))
    asked = queries.select("query_id", F.col("vector").alias("q")).where(whole("q"))
    blocks, stripes = (max(1, -(-df.count() // most)) for df, most in ((asked, block), (rows, stripe)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = asked.select("query_id", "q", F.size("q").alias("dim"), deal("query_id", blocks).alias("block"), every(stripes).alias("stripe"))
    right = rows.select("id", "v", F.size("v").alias("dim"), deal("id", stripes).alias("stripe"), every(blocks).alias("block"))

    def tile(asked: pa.Table, rows: pa.Table) -> pa.Table:
        def matrix(column):
            flat = column.combine_chunks()
            return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1 if len(flat.flatten()) else 0)

        def squares(m):
            total = np.zeros(len(m))
            for d in range(m.shape[1]):
                total += m[:, d] * m[:, d]
            return total

        if not len(asked) or not len(rows):
            return pa.table({"query_id": asked["query_id"][:0], "id": rows["id"][:0], "cosine": pa.array([], pa.float64())})
        rows = rows.sort_by("id")
        v, q = matrix(rows["v"]), matrix(asked["q"])
        # of equal vectors the least k ids alone can be among the best
        same = np.unique(v, axis=0, return_inverse=True)[1].ravel() if v.shape[1] else np.zeros(len(v), np.int64)
        order = np.argsort(same, kind="stable")
        starts = np.flatnonzero(np.diff(same[order], prepend=-1))
        kept = np.sort(order[np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order))) < k])
        v, ids = v[kept], rows["id"].combine_chunks().take(pa.array(kept))
        vv, qq = squares(v), squares(q)
        with np.errstate(all="ignore"):
            near_v, near_q = v / np.sqrt(vv)[:, None], q / np.sqrt(qq)[:, None]
        found = []
        for at in range(0, len(q), 256):
            score = near_q[at : at + 256] @ near_v.T
            score[np.isnan(score)] = np.inf
            if len(v) > k:
                least = np.partition(score, len(v) - k, axis=1)[:, len(v) - k]
                qi, vi = np.nonzero(score >= least[:, None] - 1e-9)
            else:
                qi, vi = np.nonzero(np.ones(score.shape, bool))
            qi += at
            dot = np.zeros(len(qi))
            for d in range(v.shape[1]):
                dot += q[qi, d] * v[vi, d]
            with np.errstate(all="ignore"):
                cosine = np.clip(dot / np.sqrt(qq[qi] * vv[vi]), -1, 1)
            order = np.lexsort((vi, np.where(np.isnan(cosine), -np.inf, -cosine), qi))
            qi, vi, cosine = qi[order], vi[order], cosine[order]
            first = np.flatnonzero(np.diff(qi, prepend=-1))
            best = np.arange(len(qi)) - np.repeat(first, np.diff(first, append=len(qi))) < k
            found.append((qi[best], vi[best], cosine[best]))
        qi, vi, cosine = map(np.concatenate, zip(*found))
        return pa.table({"query_id": asked["query_id"].combine_chunks().take(pa.array(qi)), "id": ids.take(pa.array(vi)), "cosine": pa.array(cosine)})

    schema = StructType([asked.schema["query_id"], rows.schema["id"], StructField("cosine", DoubleType())])
    key = ("block", "stripe", "dim")
    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(tile, schema)
    best = Window.partitionBy("query_id").orderBy(F.desc("cosine"), "id")
    return near.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).select("query_id", "id", "cosine", "place")


#: Names of a block that are compared all with all.
FEW_NAMES = 128


def shortened(text: Column, most: int) -> Column:
    """The hashes of ``text`` and of all that is left of it when up to ``most`` characters are taken out, each once."""
    at = lambda t, k: F.substring(t, k, 1)
    left, all_ = F.array(text), F.array(text)
    for _ in range(most):
        # of a run of equal characters the first alone is taken out, the others leave the same
        less = lambda t: F.transform(
            F.filter(F.sequence(F.lit(1), F.greatest(F.length(t), F.lit(1))), lambda k: (F.length(t) > 0) & ((k == 1) | (at(t, k) != at(t, k - 1)))),
            lambda k: F.concat(F.substring(t, F.lit(1), k - 1), F.substring(t, k + 1, F.length(t))))
        left = F.array_distinct(F.flatten(F.transform(left, less)))
        all_ = F.concat(all_, left)
    return F.array_distinct(F.transform(all_, lambda t: F.xxhash64(t)))


def duplicate_candidates(people: DataFrame, max_edits: int = 2) -> DataFrame:
    """(a, b, edits): pairs for review that agree in surname sound, decade of birth and place, with given names ``max_edits`` apart at most.

    ``people`` is (handle, first_name, surname, birth_year, place). A name alone
    never makes a pair. Blocks are keyed by all three; within one the
    distinct given names are compared once, ended as soon as they are too far apart, and
    give the pairs of all who bear them. Names that are ``max_edits`` apart at most leave the same when so many characters
    are taken out of each, so that in blocks of more than ``FEW_NAMES`` only those meet that leave the same; what
    all names of a block begin with is set aside, since it changes no distance.
    """
    p = people.where("surname is not null and birth_year is not null and place is not null and first_name is not null").select(
        F.soundex("surname").alias("s"), F.floor(F.col("birth_year") / 10).alias("d"), "place", "first_name", "handle")
    block = ["s", "d", "place"]
    names = cut(p.select(*block, "first_name").distinct())
    sizes = cut(names.groupBy(*block).agg(F.count("*").alias("n"), F.min("first_name").alias("low"), F.max("first_name").alias("high")))
    same = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.length("low"), F.lit(1))), lambda k: (k <= F.length("low")) & (F.substring("low", F.lit(1), k) == F.substring("high", F.lit(1), k))))
    met = names.join(beside(sizes.select(*block, "n", same.alias("same")), sizes.count()), block)
    rest = F.col("first_name").substr(F.col("same") + 1, F.length("first_name"))
    # the hash comes first among the keys, since rows are sorted by it
    keys = F.when(F.col("n") <= FEW_NAMES, F.array(F.xxhash64(*block))).otherwise(F.transform(shortened(rest, max_edits), lambda k: F.xxhash64(k, *map(F.col, block))))
    keyed = met.select(*block, F.explode(keys).alias("key"), "first_name")
    other = keyed.withColumnRenamed("first_name", "nb").hint("merge")
    near = keyed.withColumnRenamed("first_name", "na").join(other, ["key", *block]).where("na < nb").withColumn("edits", F.levenshtein("na", "nb", max_edits)).where("edits >= 0")
    alike = names.select(*block, F.col("first_name").alias("na"), F.col("first_name").alias("nb"), F.lit(0).alias("edits"))
    near = near.select(*block, "na", "nb", "edits").union(alike).repartition(*block, "na").distinct()
    bearers = lambda name, who: p.select(*block, F.col("first_name").alias(name), F.col("handle").alias(who)).hint("merge")
    rows = near.join(bearers("na", "x"), [*block, "na"]).join(bearers("nb", "y"), [*block, "nb"])
    return rows.where((F.col("na") != F.col("nb")) & (F.col("x") != F.col("y")) | (F.col("x") < F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "edits")
