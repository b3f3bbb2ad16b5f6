"""A training-data pipeline over ``documents``: five stages, each one operator of ``kinframe.llm``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
each stage's rows to the session's shared folder and reads them as the next
stage's input, so that a lost executor costs a stage at most.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinframe.llm.bpe import digests
from kinframe.llm.common import cut, read, shared_folder, without
from kinframe.llm.decontamination import mark_contaminated
from kinframe.llm.jaccard_join import similar_components
from kinframe.llm.language_id import fold, predict_languages, train
from kinframe.llm.line_dedup import dedup_lines

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Least probability of its likeliest language with which a document stays.
LEAST_SCORE = 0.4


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents of no language; a null ``lang`` becomes the predicted one.

    The network (trained on the documents outside op2's held-out fold) gives each
    whole text a language and its probability. Rejected: null, empty and letterless
    texts, and texts of which no language has ``LEAST_SCORE``, such as mixtures of
    several. Where nothing is labelled there is no network, and texts with a letter
    stay. Repeated rows are each judged, extra columns are left out, an empty table
    gives an empty one.
    """
    docs = docs.select(*COLUMNS)
    model = train(docs.where(fold("doc_id", 4) != 2).select("doc_id", "text", "lang"))
    if model is None:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    named = predict_languages(docs.withColumn("__body", F.col("text")), model, "__body", COLUMNS)
    told = named.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return told.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes repeated lines out of the texts; every document stays, with its new length.

    Null texts become empty; rows of one id count as one document, a null id loses
    nothing; extra columns are left out, an empty table gives an empty one.
    """
    docs = docs.select(*COLUMNS)
    kept = dedup_lines(docs, keep=("lang", "source"))
    return kept.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least id of each component of texts with five-word Jaccard similarity of 0.8 or more.

    Texts without a word and rows of null id are alone and stay; rows that repeat an
    id stay or go together; extra columns are left out, an empty table gives an empty one.
    """
    docs = docs.select(*COLUMNS)
    leave = cut(similar_components(docs, n=5, percent=80).where("component <> doc_id").select("doc_id").distinct())
    return without(docs, leave, "doc_id").select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null and empty texts hold none, repeated rows are each judged, an empty table gives an empty one."""
    marked = mark_contaminated(docs.select(*COLUMNS), read(spark, sf_dir, "benchmark"), out_col="__found")
    return marked.where(F.size("__found") == 0).select(*COLUMNS)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes of every row; null and empty texts have no token, an empty table gives an empty result."""
    return digests(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("byte_bpe", token_stage),
]

#: The models of the first and fourth stage, the components of the third and the
#: tokenizer are beyond SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``: (doc_id, n_tokens, ids_sha256, decoded_sha256) of each document that is kept.

    What a stage does with nulls, repeated rows and empty tables, its docstring says.
    """
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}_{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
