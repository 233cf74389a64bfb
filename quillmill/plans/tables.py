"""The driver's tables in the shapes that the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F


#: Accented letters and the capitals that stand for them where texts are compared letter by letter in lower case.
ACCENTS = ("éßóçäñèíêüöáâàùûôîïúë", "ABCDEFGHIJKLMNOPQRSTU")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id, source_path, text, confidence, page_count; the last two follow from id and length."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"),
        F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("source_path"),
        "text",
        (0.5 + F.pmod("doc_id", F.lit(50)) / 100).alias("confidence"),
        F.floor(F.col("n_chars") / 100).cast("int").alias("page_count"),
        "doc_id", "lang", "source", "n_chars",
    )


def paged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with ``pages``: its lines as pages."""
    lines = F.split("text", "\n")
    return documents(spark, sf_dir).withColumn("pages", F.transform(lines, lambda t, i: F.struct(i.cast("int").alias("page_number"), t.alias("text"), F.lit("native").alias("method"))))


def windows(spark: SparkSession, sf_dir: str, size: int = 700) -> DataFrame:
    """Fixed-width chunks over whole documents: document_id, chunk_index, start_char, end_char, content_type, text."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "text")
    n = F.ceil(F.length("text") / size).cast("int")
    each = docs.filter("length(text) > 0").select("document_id", "text", F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_index"))
    start = F.col("chunk_index") * size
    return each.select("document_id", "chunk_index", start.alias("start_char"), F.least(start + size, F.length("text")).alias("end_char"), F.lit("narrative").alias("content_type"), F.substring("text", start + 1, F.lit(size)).alias("text"))


def line_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of a document as a span: document_id, ord, start, end, line."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("document_id"), F.split("text", "\n").alias("lines"))
    # the place of every line is found by one running sum a document
    each = docs.select("document_id", F.posexplode("lines").alias("ord", "line")).withColumn("size", F.length("line") + 1)
    before = F.coalesce(F.sum("size").over(Window.partitionBy("document_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    return each.withColumn("start", before).select("document_id", "ord", "start", (F.col("start") + F.col("size") - 1).alias("end"), "line").filter("end > start")


def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An enrichment for every document, made from its text: first and last words become entities."""
    from quillmill.functions.enrichment import ENTITIES, SCHEMA

    span = lambda a, b: F.struct(F.greatest(F.lit(0), a).cast("int").alias("start"), F.greatest(F.lit(0), b).cast("int").alias("end"))
    n = F.length("text")
    first, last, mid = span(F.lit(0), F.least(n, F.lit(10))), span(n - 8, n), span((n / 2).cast("int") - 5, (n / 2).cast("int") + 5)
    null = F.lit(None).cast("string")
    person = lambda i, kind, parent, home, m: F.struct(F.lit(i).alias("id"), first.alias("name"), F.lit(kind).alias("type"), F.lit("other").alias("role"), m.alias("mentions"), parent.alias("parent"), F.array().cast("array<string>").alias("children"), home.alias("residence"))
    made = {
        "persons": F.array(person("p1", "natural", null, F.lit("l1"), F.array(first, last)), person("p2", "corporate", F.lit("p1"), null, F.array(mid))),
        "locations": F.array(F.struct(F.lit("l1").alias("id"), mid.alias("name"), F.when(F.col("doc_id") % 2 == 0, "address").otherwise("city").alias("type"), F.array(mid, last).alias("mentions"), null.alias("parent"), F.array().cast("array<string>").alias("children"))),
        "emails": F.array(F.struct(F.concat(F.lit("m"), "document_id", F.lit("@example.org")).alias("address"), F.lit("p1").alias("person"), F.array(last).alias("mentions"))),
        "terms": F.array(F.struct(F.lit("t1").alias("id"), last.alias("name"), first.alias("meaning"), F.array(first).alias("mentions"))),
        "external_documents": F.array(F.struct(F.lit("x1").alias("id"), first.alias("name"), F.lit("statute").alias("type"), F.lit("neutral").alias("reception"), F.array(mid).alias("mentions"), F.array().cast("array<struct<start:int,end:int>>").alias("pinpoints"), F.lit("au").alias("jurisdiction"))),
        "crossreferences": F.array(F.struct(F.lit("s1").alias("start"), F.lit("s2").alias("end"), last.alias("span"))),
        "segments": F.array(*[F.struct(F.lit(i).alias("id"), F.lit("unit").alias("kind"), F.lit("section").alias("type"), F.lit("main").alias("category"), s.alias("span"), p.alias("parent"), F.array().cast("array<string>").alias("children"), F.lit(k).alias("level"), first.alias("type_name"), first.alias("code"), first.alias("title")) for i, s, p, k in (("s1", span(F.lit(0), n), null, 0), ("s2", mid, F.lit("s1"), 1))]),
        "dates": F.array(F.struct(F.lit("2024-01-31").alias("value"), F.lit("effective").alias("type"), F.array(last).alias("mentions"), F.when(F.col("doc_id") % 3 == 0, F.lit("p1")).alias("person"))),
    }
    fields = [F.col("text"), F.lit("decision").alias("type"), F.lit("au").alias("jurisdiction"), first.alias("title"), span(F.lit(0), F.lit(0)).alias("subtitle")]
    fields += [made[k].alias(k) if k in made else F.array().cast(f"array<struct<{v}>>").alias(k) for k, v in ENTITIES.items()]
    fields += [F.array(first).alias("headings"), F.array().cast("array<struct<start:int,end:int>>").alias("junk")]
    return documents(spark, sf_dir).select("document_id", F.struct(*fields).cast(SCHEMA).alias("e"))


def customer_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as a sheet of strings, rows numbered by key."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").cast("string"), "c_name", F.col("c_nationkey").cast("string"), F.col("c_acctbal").cast("decimal(12,2)").cast("string").alias("c_acctbal"), "c_mktsegment", (F.col("c_custkey") - 1).alias("row_index"))


def customer_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sheet with faults: every 101st name in capitals, every 97th key repeated from its neighbour, an extra column."""
    s = customer_sheet(spark, sf_dir)
    k = F.col("c_custkey").cast("bigint")
    return s.select(
        F.when(k % 97 == 0, (k - 1).cast("string")).otherwise(F.col("c_custkey")).alias("c_custkey"), F.when(k % 101 == 0, F.upper("c_name")).otherwise(F.col("c_name")).alias("c_name"), "c_nationkey", "c_acctbal", F.col("c_mktsegment").alias("c_segment"), "row_index"
    )
