"""Shape files to Parquet with geometry and provenance."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmill.sources import office
from quillmill.sources.files import discover_recursive, md5_of_files
from quillmill.sources.tabular import with_provenance


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """One file's features, its attributes as columns before the geometry."""
    base = path.rsplit(".", 1)[0]
    folder, stem = base.rsplit("/", 1) if "/" in base else (".", base)
    df = office.shape_rows(office.contents(spark, folder, f"{stem}.*"))
    first = df.select("attributes").first()
    names = list(first["attributes"] or {}) if first else []
    return df.select(*[F.col("attributes")[n].alias(n) for n in names], "geometry", "valid", "geometry_type", "crs", "error")


def ingest_shapes(spark: SparkSession, path: str, out: str, md5: bool = False) -> dict:
    """Write one file; its facts and the description of its geometry column go into the columns' metadata. Invalid features are counted, not dropped."""
    df = read_shapes(spark, path)
    facts = df.agg(F.count("geometry").alias("features"), F.count_if(~F.col("valid")).alias("invalid"), F.first("crs", True).alias("crs"), F.first("geometry_type", True).alias("kind"), F.first("error", True).alias("error")).first()
    if facts["error"]:
        return {"source": path, "output": None, "features": 0, "error": facts["error"]}
    geo = {"version": "1.0.0", "primary_column": "geometry", "columns": {"geometry": {"encoding": "WKB", "geometry_types": [facts["kind"]] if facts["kind"] else []}}}
    digest = md5_of_files(spark, path).first()["md5"] if md5 else None
    body = df.drop("valid", "geometry_type", "crs", "error")
    with_provenance(body, source_file=path.rsplit("/", 1)[-1], feature_count=facts["features"], crs=facts["crs"], geometry_type=facts["kind"], invalid_geometries=facts["invalid"], source_md5=digest, geo=json.dumps(geo)).write.mode("overwrite").parquet(out)
    return {"source": path, "output": out, "features": facts["features"], "crs": facts["crs"], "geometry_type": facts["kind"], "error": None}


def ingest_shape_directory(spark: SparkSession, root: str, out: str, md5: bool = False) -> list[dict]:
    """Every shape file below ``root``; a file that fails stays in the list with its error."""
    done = []
    for r in discover_recursive(spark, root, "shp").collect():
        stem = r["path"].rsplit("/", 1)[-1].rsplit(".", 1)[0]
        done.append(ingest_shapes(spark, r["path"], f"{out.rstrip('/')}/{stem}.parquet", md5))
    return done
