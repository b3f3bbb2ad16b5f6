"""Operator 1: repeated lines across documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinframe.llm.common import ASCII_SPACE, ascii_lower, cut, hash128, read, refuse_clash


def line_key(line: Column) -> Column:
    """What makes two lines the same: stripped of ASCII white space, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_length: int = 10,
    min_docs: int = 2,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Drop lines found in ``min_docs`` or more documents, except in the least id that holds them.

    Lines are exploded, their keys hashed to 128 bits and the distinct documents
    of each hash counted with partial aggregation, so that a line that stands in
    every document is a few partial rows, never a group in one task. For
    ``min_docs=2`` "two distinct ids" is ``min <> max``, one shuffle; beyond, ids
    are counted distinctly. The repeated hashes are cut to the checkpoint folder, so
    that they meet the lines in a join that Spark splits where one line is very
    common. The positions to drop then meet their document, and the rest is put
    together by position. Text is shuffled once, by document.

    Returns (id, lines long, dropped long, text, and the columns ``keep``):
    ``text`` is the kept text.
    Null or empty text is one empty line. Rows with a null id count nowhere and
    lose nothing. Rows that repeat an id count as one document; each row is
    returned. Other columns are not looked at; one in ``keep`` named like a new one
    is an error. An empty table gives an empty result.
    """
    refuse_clash(docs, keep, (id_col, "lines", "dropped", "text"))
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"), F.struct(F.lit(0), *keep).alias("kept_columns"))
    base = base.select("id", F.xxhash64("body").alias("tk"), F.split("body", "\n", -1).alias("lines"), "kept_columns")
    h1, h2 = hash128(F.col("key"))
    lines = (
        base.where("id is not null")
        .select("id", "tk", F.posexplode("lines").alias("pos", "line"))
        .select("id", "tk", "pos", line_key(F.col("line")).alias("key"))
        .where(F.length("key") >= min_length)
        .select("id", "tk", "pos", h1.alias("h1"), h2.alias("h2"))
    )
    if min_docs == 2:
        repeated = lines.groupBy("h1", "h2").agg(F.min("id").alias("home"), F.max("id").alias("last")).where("home <> last")
    else:
        repeated = lines.groupBy("h1", "h2").agg(F.min("id").alias("home"), F.countDistinct("id").alias("n")).where(F.col("n") >= min_docs)
    drops = (
        lines.join(cut(repeated.select("h1", "h2", "home")), ["h1", "h2"])
        .where("id <> home")
        .groupBy("id", "tk")
        .agg(F.collect_list("pos").alias("drop"))
    )
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop")), lambda i: F.get(F.col("lines"), i))
    return (
        base.join(drops, ["id", "tk"], "left")
        .select("id", F.size("lines").cast("long").alias("n"), F.when(F.col("drop").isNull(), F.col("lines")).otherwise(kept).alias("kept"), "kept_columns")
        .select(
            F.col("id").alias(id_col),
            F.col("n").alias("lines"),
            (F.col("n") - F.size("kept")).alias("dropped"),
            F.array_join("kept", "\n").alias("text"),
            *(F.col("kept_columns")[c].alias(c) for c in keep),
        )
    )


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digest of what is left of every document of ``documents``; null and empty texts are one empty line."""
    out = dedup_lines(read(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        F.col("lines").alias("n_lines"),
        F.col("dropped").alias("n_dropped"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"),
    )


OP1_SQL = r"""
with lines as (
  select doc_id, pos, line, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k
  from (select doc_id, unnest(string_split(coalesce(text, ''), E'\n')) as line,
               generate_subscripts(string_split(coalesce(text, ''), E'\n'), 1) as pos
        from documents)),
repeated as (
  select k, min(doc_id) as home from lines where length(k) >= 10
  group by k having count(distinct doc_id) >= 2),
marked as (
  select l.*, (r.k is not null and l.doc_id <> r.home) as gone
  from lines l left join repeated r on l.k = r.k)
select doc_id, count(*)::bigint as n_lines, (count(*) filter (gone))::bigint as n_dropped,
       sha256(coalesce(string_agg(line, E'\n' order by pos) filter (not gone), '')) as kept_sha256
from marked group by doc_id
"""
