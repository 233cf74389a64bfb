"""Cleaning of personal data in pages and chunks, alone or with known spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillmill.functions import spans as S


def clean(df: DataFrame, text_col: str = "text", out_col: str = "text_clean", entities=("PERSON",), threshold: float = 0.35, scorer=S.hashed_context_scores) -> DataFrame:
    """Adds the cleaned text and ``pii_count``; the raw text, to which offsets refer, stays."""
    found = S.keep_first(S.find_candidates(F.col(text_col), entities, threshold, scorer))
    return df.withColumn("__found", found).withColumns({out_col: S.splice(F.col(text_col), F.col("__found")), "pii_count": F.size("__found")}).drop("__found")


def clean_with_known(df: DataFrame, known_col: str, offset_col: str, text_col: str = "text", out_col: str = "text_clean", entities=("PERSON",), threshold: float = 0.35, scorer=S.hashed_context_scores) -> DataFrame:
    """As ``clean``, with spans known for the whole document; the higher score wins where starts tie.

    ``known_col``: array of structs start, end, entity_type in the document's coordinates.
    """
    own = S.find_candidates(F.col(text_col), entities, threshold, scorer)
    known = S.rebase_known(F.coalesce(F.col(known_col), F.array()), F.col(offset_col), F.length(text_col))
    found = S.keep_first(F.concat(own, known.cast(S.SPANS)), by_score=True)
    return df.withColumn("__found", found).withColumns({out_col: S.splice(F.col(text_col), F.col("__found")), "pii_count": F.size("__found")}).drop("__found")


def clean_pages(df: DataFrame, pages_col: str = "pages", **options) -> DataFrame:
    """Clean every page of a document and put the document together again."""
    pages = df.select("document_id", F.posexplode(pages_col).alias("__i", "__p")).select("document_id", "__i", "__p", F.col("__p.text").alias("text"))
    done = clean(pages, **options)
    back = done.groupBy("document_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("__i", F.col("__p").withField("text", F.col("text_clean")).alias("p")))), lambda x: x["p"]).alias("__pages"), F.sum("pii_count").alias("pii_count")
    )
    return df.join(back, "document_id", "left").withColumn(pages_col, F.coalesce("__pages", pages_col)).withColumn("pii_count", F.coalesce("pii_count", F.lit(0))).drop("__pages")


def spans_from_mentions(mentions: DataFrame, labels=("person", "location")) -> DataFrame:
    """Rows of usable spans, sorted by start within a document."""
    ok = (F.col("mention_start") >= 0) & (F.col("mention_end") > F.col("mention_start")) & F.col("entity_label").isin(*labels)
    return mentions.filter(ok).select("document_id", "mention_start", "mention_end", "entity_label").orderBy("document_id", "mention_start", "mention_end", "entity_label")


def tag_counts(df: DataFrame, text_col: str = "text_clean") -> DataFrame:
    """How often each replacement tag stands in the cleaned texts."""
    tags = F.regexp_extract_all(F.col(text_col), F.lit("<([A-Z_]+)>"), F.lit(1))
    return df.select(F.explode(tags).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def cleaning_scores(truth: DataFrame, raw_col: str = "raw", clean_col: str = "clean", span_col: str = "span_text", supported=("PERSON", "ADDRESS")) -> DataFrame:
    """One row: recall, precision, coverage and their counts.

    ``truth``: document_id, raw and cleaned text, span_text, entity_type, one row a true span.  A span is found if the
    raw text has it and the clean one no longer does; precision is found spans to tags, a document's tags counted once;
    coverage is the share of the spans whose kind is supported.  Zero where nothing can be counted.
    """
    gone = F.col(raw_col).contains(F.col(span_col)) & ~F.col(clean_col).contains(F.col(span_col))
    tags = F.size(F.regexp_extract_all(F.col(clean_col), F.lit("<([A-Z_]+)>"), F.lit(1)))
    per = truth.groupBy("document_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(gone).alias("found"), F.count_if(F.col("entity_type").isin(*supported)).alias("covered"), F.max(tags).alias("tags"))
    total = per.agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in ("n", "found", "covered", "tags")])
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return total.select(rate("found", "n").alias("recall"), rate("found", "tags").alias("precision"), rate("covered", "n").alias("coverage"), "n", "found", "tags")
