"""A session with the settings that the engine wants."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark import SparkConf
from pyspark.sql import SparkSession

_shipped: set[str] = set()
#: Bytes of an Arrow batch that goes to a Python worker, and Spark's own bound, which is left alone where it was changed.
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH, USUAL_BATCH = "8m", str(64 << 20)


def bound_batches(spark: SparkSession) -> None:
    """Batches of 8 instead of 64 MB: a worker holds several copies of one, next to an executor's heap."""
    if spark.conf.get(BATCH_BYTES, USUAL_BATCH).rstrip("b") == USUAL_BATCH:
        spark.conf.set(BATCH_BYTES, BATCH)


def ship(spark: SparkSession) -> None:
    """Send the package to the executors, once an application, so that their Python workers can import it wherever they run; bound their batches.

    The archive is made on the driver alone; Spark serves it to the executors.
    """
    bound_batches(spark)
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="quillmill-"), "quillmill_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(here):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def get_session(cpus: int | str = "*", app: str = "quillmill", **conf: str) -> SparkSession:
    """On a cluster the master comes from the submit command or the environment; where there is none it is local."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    }
    builder = SparkSession.builder.appName(app).config(map=base | conf)
    submitted = os.environ.get("MASTER") or os.environ.get("SPARK_REMOTE") or "--master" in os.environ.get("PYSPARK_SUBMIT_ARGS", "") or SparkConf().contains("spark.master")
    return (builder if submitted else builder.master(f"local[{cpus}]")).getOrCreate()
