"""The corpus pipeline: five stages over ``documents``, each written and reread.

Quality rules, SimHash near-copies, personal data, mixing of sources, BPE.

Defined cases: columns are found as Spark finds them, whatever their case, and
a missing one is an error; ids keep their type; all stages but the last return
the table's own columns, clashing names and all.  Null, empty and blank texts go
in the first stage, very long ones are judged, cleaned, cut and encoded whole.
Rows without an id stay and are never copies of each other.  Repeated rows (same
id, same text) are judged alike; the second stage keeps one of them, the least
by its other columns, and two texts of one id are two documents.  A null source
is a source of its own and comes back null; ``lang`` and other columns may be
missing.  An empty table gives empty stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm import bpe_codec, pii_anchors, quality_rules, shared, simhash_dedup, source_mixing
from quillmill.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose compression stays inside the bands; null, empty and blank texts go, texts under 64 bytes stay."""
    ship(spark)
    return quality_rules.keep_by_compression(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the least id; texts without a word and rows without an id stay."""
    ship(spark)
    return simhash_dedup.drop_near_copies(docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; null texts stay null, ``n_chars`` is counted anew where it is there."""
    ship(spark)
    return pii_anchors.redact_private(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the blocks that the mixture draws, as documents; a block that is drawn twice comes twice, pieces without text don't."""
    ship(spark)
    return source_mixing.mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every piece and the text that they decode to; null texts have no ids and decode to null."""
    ship(spark)
    return bpe_codec.encode_decode(docs)


STAGES = [("quality", quality), ("near_copies", near_copies), ("private_data", private_data), ("mixture", mixture), ("tokens", tokens)]

#: Compression, SimHash, the parsers and BPE can't be said in SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages one after the other; what a stage wrote on its way goes once its result stands."""
    docs, last = shared.read_table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        start = shared.mark()
        docs = shared.written(stage(spark, docs, sf_dir), f"stage-{name}")
        *work, result = shared.made_since(start)
        shared.discard(spark, [*work, *last])
        last = [result]
    return STAGES[-1][1](spark, docs, sf_dir)
