"""Sinks with fixed schemas, provenance, and the control table of finished work."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

_POS = "position:struct<x:double,y:double,width:double,height:double>"
DOCUMENTS = (
    "document_id string, source_path string, text string, "
    "metadata struct<extraction_strategy:string,confidence:double,processing_time:double,page_count:int,text_coverage:double,preprocessing_steps:array<string>,content_mix:map<string,double>>, "
    f"warnings array<string>, tables array<struct<headers:array<string>,rows:array<array<string>>,{_POS},confidence:double>>, "
    f"forms array<struct<field_name:string,value:string,{_POS},confidence:double>>, images array<struct<alt_text:string,{_POS},confidence:double>>, "
    f"text_blocks array<struct<text:string,{_POS},block_type:string,confidence:double>>"
)
MENTIONS = "document_id string, entity_id string, entity_label string, name string, entity_type string, role string, mention_start int, mention_end int, chunk_index int"
EDGES = "document_id string, source_id string, target_id string, relation string, prop_key string, prop_value string"
META = "document_id string, doc_type_enriched string, jurisdiction string, title string, " + ", ".join(f"{x}_count int" for x in ("segment", "person", "location", "term", "external_doc", "date", "heading", "junk_span"))
CHUNKS = "document_id string, chunk_index int, start_char int, end_char int, text string, content_type string, has_redaction boolean"


def schema_of(spark: SparkSession, ddl: str) -> StructType:
    return spark.createDataFrame([], ddl).schema


def conform(df: DataFrame, schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the schema's columns in its order, and those to keep; those that are missing become null."""
    want = schema_of(df.sparkSession, schema)
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in want.fields], *keep)


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def write_table(df: DataFrame, path: str, schema: str, mode: str = "overwrite") -> str:
    """One Parquet table of a fixed schema, also where there are no rows."""
    conform(df, schema).write.mode(mode).parquet(path)
    return path


def write_documents(df: DataFrame, path: str, batch_id: str | None = None) -> str:
    """Completed rows only. With a batch id the batch gets a partition of its own: others stay, and a repeated run replaces its own."""
    done = df.filter("status = 'completed'") if "status" in df.columns else df
    out = conform(done, DOCUMENTS)
    if batch_id is None:
        out.write.mode("overwrite").parquet(path)
    else:
        out.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path)
    return path


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENTS).parquet(path)


def extraction_rows(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Results to document rows; without metadata the method and zeros stand in."""
    df = df if "metadata" in df.columns else df.withColumn("metadata", F.lit(None).cast(schema_of(df.sparkSession, DOCUMENTS)["metadata"].dataType))
    m = lambda f, default: F.coalesce(F.col(f"metadata.{f}"), default)
    meta = F.struct(
        m("extraction_strategy", F.col("method")).alias("extraction_strategy"), m("confidence", F.lit(0.0)).alias("confidence"), m("processing_time", F.lit(0.0)).alias("processing_time"),
        m("page_count", F.lit(0)).cast("int").alias("page_count"), m("text_coverage", F.lit(0.0)).alias("text_coverage"), F.col("metadata.preprocessing_steps"), F.col("metadata.content_mix"),
    )
    return conform(df.withColumn("metadata", meta), DOCUMENTS, keep)


def write_enrichment(enriched: DataFrame, chunks: DataFrame, out: str) -> dict[str, str] | None:
    """Mentions, edges and counts of the documents that have an enrichment; None where none has."""
    from quillmill.operators import graph

    enriched = enriched.filter(F.col("e").isNotNull())
    if enriched.isEmpty():
        return None
    chunks = chunks.join(enriched.select("document_id").distinct(), "document_id", "left_semi")
    tables = {"entities": (graph.entity_mentions(enriched, chunks), MENTIONS), "graph_edges": (graph.edges_to_rows(graph.edges(enriched, chunks)), EDGES), "enrichment_meta": (graph.enrichment_meta(enriched), META)}
    return {name: write_table(df, f"{out.rstrip('/')}/{name}.parquet", schema) for name, (df, schema) in tables.items()}


def write_text(df: DataFrame, document_id: str, path: str) -> str:
    """One document as plain text; anything but exactly one is an error."""
    rows = df.filter((F.col("document_id") == document_id) & (F.col("status") == "completed")).select("text")
    if rows.count() != 1:
        raise ValueError(f"text output needs exactly one completed document {document_id}")
    rows.coalesce(1).write.mode("overwrite").text(path)
    return path


class Progress:
    """Which source paths are done: an append-only table, so that a lost run repeats nothing and loses nothing."""

    SCHEMA = "source_path string, status string, batch_id string, at timestamp"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def load(self) -> DataFrame:
        from pyspark.errors import AnalysisException

        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException:  # nothing was recorded yet
            return self.spark.createDataFrame([], self.SCHEMA)

    def update(self, done: DataFrame, batch_id: str) -> None:
        done.select("source_path", "status", F.lit(batch_id).alias("batch_id"), F.current_timestamp().alias("at")).write.mode("append").parquet(self.path)

    def remaining(self, files: DataFrame, retry_errors: bool = True) -> DataFrame:
        """Files without a finished row; the key is the source path, so that all documents of a table file count as done with it."""
        seen = self.load()
        seen = seen.filter("status = 'completed'") if retry_errors else seen
        return files.join(seen.select("source_path").distinct(), "source_path", "left_anti")

    def counts(self) -> DataFrame:
        last = self.load().groupBy("source_path").agg(F.max_by("status", "at").alias("status"))
        return last.agg(F.count_if(F.col("status") == "completed").alias("succeeded"), F.count_if(F.col("status") != "completed").alias("failed"))
