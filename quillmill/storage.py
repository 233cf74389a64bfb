"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROW_GROUP = 32 << 20
CHECKPOINT_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a folder of our own only where it is unset, as in tests."""
    where = spark.conf.get(CHECKPOINT_CONF, "") or ""
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"on a cluster {CHECKPOINT_CONF} has to name a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="quillmill-")
        spark.conf.set(CHECKPOINT_CONF, where)
    return where


#: Paths of the tables that this driver has written, in order.
_made: list[str] = []


def made_since(mark: int) -> list[str]:
    return _made[mark:]


def mark() -> int:
    return len(_made)


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables of ours that nothing will read again."""
    for p in paths:
        if p in _made:
            _made.remove(p)
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends here and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    # small row groups, as each open file keeps one in memory
    df.write.option("compression", "zstd").option("parquet.block.size", ROW_GROUP).parquet(path)
    _made.append(path)
    return spark.read.schema(df.schema).parquet(path)
