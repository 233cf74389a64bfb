"""Fidelity of an extracted table against its source."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from quillmill.functions.text import strip
from quillmill.storage import written


def with_row_index(df: DataFrame, *order: str, name: str = "row_index") -> DataFrame:
    """Number the rows 0..n-1 in the given order without pulling them into one partition.

    The range-sorted rows are written once, each with its place in its part, so that the parts' counts and the rows
    can't disagree; a part's offset is the number of rows before it.
    """
    ranged = written((df.orderBy(*order) if order else df).withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "row-index")
    counts = ranged.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))
    # the number of partitions bounds this table
    packed = counts.agg(F.sort_array(F.collect_list(F.struct("__p", "__n"))).alias("__all"))
    before = F.aggregate(F.filter("__all", lambda x: x["__p"] < F.col("__p")), F.lit(0).cast("bigint"), lambda s, x: s + x["__n"])
    return ranged.crossJoin(F.broadcast(packed)).withColumn(name, before + F.col("__m")).drop("__p", "__m", "__all")


def structural_fidelity(source: DataFrame, extracted: DataFrame) -> DataFrame:
    """One row: row and column counts, missing and extra columns."""
    a, b = set(source.columns), set(extracted.columns)
    n = lambda df, c: df.agg(F.count(F.lit(1)).alias(c))
    missing, extra = sorted(a - b), sorted(b - a)
    return n(source, "source_rows").crossJoin(n(extracted, "extracted_rows")).select(
        "source_rows",
        F.lit(len(source.columns)).cast("bigint").alias("source_cols"),
        "extracted_rows",
        F.lit(len(extracted.columns)).cast("bigint").alias("extracted_cols"),
        F.lit(",".join(missing)).alias("missing_columns"),
        F.lit(",".join(extra)).alias("extra_columns"),
        ((F.col("source_rows") == F.col("extracted_rows")) & F.lit(not missing and not extra)).alias("passed"),
    )


def cell_mismatches(source: DataFrame, extracted: DataFrame, index: str = "row_index") -> DataFrame:
    """(row_index, column, source_value, extracted_value) of the cells that differ; rows beyond the shorter table are left out."""
    shared = sorted((set(source.columns) & set(extracted.columns)) - {index})
    text = lambda side, c: F.coalesce(F.col(f"{side}.{c}").cast("string"), F.lit(""))
    joined = source.alias("s").join(extracted.alias("e"), F.col(f"s.{index}") == F.col(f"e.{index}"))
    cells = F.array(*[F.struct(F.lit(c).alias("column"), text("s", c).alias("source_value"), text("e", c).alias("extracted_value")) for c in shared])
    bad = F.filter(cells, lambda x: x["source_value"] != x["extracted_value"])
    return joined.select(F.col(f"s.{index}").alias("row_index"), F.explode(bad).alias("x")).select("row_index", "x.*")


def data_integrity(source: DataFrame, extracted: DataFrame, index: str = "row_index") -> DataFrame:
    """One row: passed, total and mismatched cells, score."""
    shared = sorted((set(source.columns) & set(extracted.columns)) - {index})
    if not shared:
        return source.sparkSession.sql("SELECT false AS passed, 0L AS total_cells, 0L AS mismatched_cells, 0.0D AS score")
    joined = source.alias("s").join(extracted.alias("e"), F.col(f"s.{index}") == F.col(f"e.{index}"))
    bad = reduce(lambda a, b: a + b, [(F.coalesce(F.col(f"s.{c}").cast("string"), F.lit("")) != F.coalesce(F.col(f"e.{c}").cast("string"), F.lit(""))).cast("bigint") for c in shared])
    one = joined.agg((F.count(F.lit(1)) * len(shared)).alias("total_cells"), F.coalesce(F.sum(bad), F.lit(0)).alias("mismatched_cells"))
    score = F.when(F.col("total_cells") == 0, F.lit(1.0)).otherwise(1 - F.col("mismatched_cells") / F.col("total_cells"))
    return one.select((F.col("mismatched_cells") == 0).alias("passed"), "total_cells", "mismatched_cells", score.alias("score"))


def first_mismatches(source: DataFrame, extracted: DataFrame, most: int = 20, index: str = "row_index") -> DataFrame:
    """The report's first mismatches, row by row; the limit is the report's own."""
    return cell_mismatches(source, extracted, index).orderBy("row_index", "column").limit(most)


def missing_keys(source: DataFrame, extracted: DataFrame, key: str) -> DataFrame:
    k = strip(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("key")
    return source.select(k).distinct().join(extracted.select(k), "key", "left_anti")


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    k = strip(F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("key")
    return df.select(k).groupBy("key").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def first_keys(keys: DataFrame, most: int = 20) -> DataFrame:
    """The report's first missing or repeated keys, in order; the limit is the report's own."""
    return keys.select("key").orderBy("key").limit(most)


def key_preservation(source: DataFrame, extracted: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys of both sides, how many are missing or repeated."""
    k = strip(F.coalesce(F.col(key).cast("string"), F.lit("")))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    unique = lambda df, name: df.agg(F.countDistinct(k).alias(name))
    return (
        unique(source, "source_unique")
        .crossJoin(unique(extracted, "extracted_unique"))
        .crossJoin(n(missing_keys(source, extracted, key), "missing_keys"))
        .crossJoin(n(duplicate_keys(extracted, key), "duplicate_keys"))
        .withColumn("passed", F.expr("missing_keys = 0 AND duplicate_keys = 0"))
    )


def _shape(schema) -> list:
    """Types and names of a schema, whatever may be null."""

    def bare(t):
        if isinstance(t, StructType):
            return [(f.name, bare(f.dataType)) for f in t.fields]
        if t.typeName() == "array":
            return ["array", bare(t.elementType)]
        if t.typeName() == "map":
            return ["map", bare(t.keyType), bare(t.valueType)]
        return t.simpleString()

    return bare(schema)


def schema_conforms(df: DataFrame, expected: StructType) -> bool:
    return _shape(df.schema) == _shape(expected)
