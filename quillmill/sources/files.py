"""Files: discovery, text, digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillmill.operators.classify import DISCOVERED


def name_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def stem_of(path: Column) -> Column:
    return F.regexp_replace(name_of(path), r"\.[^.]+$", "")


def discover(spark: SparkSession, root: str, skip: int = 0, limit: int | None = None, extensions=DISCOVERED) -> DataFrame:
    """Supported files right under ``root``, by name; no content is read."""
    files = spark.read.format("binaryFile").load(root).select("path", "length", "modificationTime")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    out = files.filter(ext.isin(*extensions)).withColumn("name", name_of(F.col("path"))).orderBy("name")
    out = out.offset(skip) if skip else out
    return out.limit(limit) if limit else out


def discover_recursive(spark: SparkSession, root: str, extension: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}").load(root)
    return files.select("path", "length").orderBy("path")


def read_text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, document_id, text, confidence): UTF-8, or Latin-1 where the bytes aren't."""
    raw = spark.read.format("binaryFile").load(path)
    text = F.when(F.expr("is_valid_utf8(CAST(content AS STRING))"), F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    return raw.select("path", stem_of(F.col("path")).alias("document_id"), text.alias("text"), F.lit(1.0).alias("confidence"))


def md5_of_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", F.md5("content").alias("md5"))
