"""Names and types of columns; intermediate tables are the engine's own."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from quillmill.storage import discard, made_since, mark, shared_dir, written


def unused(name: str, columns: list[str]) -> str:
    """A column name like ``name`` that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def column(name: str) -> Column:
    """The column of exactly this name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def resolved(df: DataFrame, name: str) -> str:
    """The table's own name of a column, found as Spark finds it; an error where there is none, or more than one."""
    same = str(df.sparkSession.conf.get("spark.sql.caseSensitive")).lower() == "true"
    found = [c for c in df.columns if c == name or not same and c.lower() == name.lower()]
    if len(found) != 1:
        raise ValueError(f"{'no' if not found else 'more than one'} column {name!r} among {df.columns}")
    return found[0]


def type_of(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


__all__ = ["column", "discard", "made_since", "mark", "read_table", "resolved", "shared_dir", "type_of", "unused", "written"]
