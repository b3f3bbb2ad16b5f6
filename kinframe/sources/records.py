"""Reading records strictly, and media files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Media types by file ending.
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "tif": "image/tiff", "tiff": "image/tiff", "pdf": "application/pdf", "txt": "text/plain", "html": "text/html", "mp3": "audio/mpeg", "mp4": "video/mp4"}


def read_records(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "parquet") -> DataFrame:
    """One record table with a given schema; nothing is inferred."""
    return spark.read.schema(schema).format(fmt).load(path)


def ingest(lines: DataFrame, schema: T.StructType, required: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) from JSON lines in column ``value``.

    A line is rejected, with its reason, when it is no JSON object, has a key the
    schema does not know, a value of the wrong type, or lacks a required field.
    """
    probe = T.StructType([*schema.fields, T.StructField("__bad", T.StringType())])
    r = F.from_json("value", probe, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    rows = lines.select("value", r.alias("r"), F.json_object_keys("value").alias("keys"))
    unknown = F.array_except("keys", F.array(*map(F.lit, schema.names)))
    lacking = F.array_compact(F.array(*(F.when(F.col("r")[c].isNull(), c) for c in required))) if required else F.array().cast("array<string>")
    reason = (
        F.when(F.col("keys").isNull(), "not an object").when(F.size(unknown) > 0, F.concat(F.lit("unknown: "), F.array_join(F.array_sort(unknown), ", ")))
        .when(F.col("r")["__bad"].isNotNull(), "wrong type").when(F.size(lacking) > 0, F.concat(F.lit("missing: "), F.array_join(lacking, ", ")))
    )
    judged = rows.withColumn("reason", reason)
    return judged.where("reason is null").select(*(F.col("r")[c].alias(c) for c in schema.names)), judged.where("reason is not null").select("value", "reason")


def ingest_media(spark: SparkSession, path: str) -> DataFrame:
    """(path, mime, size, checksum) of the files under ``path``."""
    ending = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    mime = F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in MIME.items() for x in kv)), ending), F.lit("application/octet-stream"))
    return spark.read.format("binaryFile").load(path).select("path", mime.alias("mime"), F.col("length").alias("size"), F.md5("content").alias("checksum"))


def missing_media(media: DataFrame, files: DataFrame) -> DataFrame:
    """Media records whose file is not in the listing ``files`` (path)."""
    return media.join(files.select("path").distinct(), "path", "left_anti")
