"""Token counts by rank-synchronous array merging.

Per Arrow batch the pre-tokens of all texts are held as one ragged numpy
array; every round applies each sequence's lowest-rank pair at the same time
and the symbols that survive are counted.  No token list is ever built as
Python objects and nothing is shuffled.

Defined cases: a null or empty text has 0 tokens; a null id passes through and
ids keep their type; repeated rows are counted each for itself; very long texts
are counted whole, also where they are one pre-token; of equal lowest ranks the
leftmost pairs merge; an empty table gives an empty result; other columns of the
input are never looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillmill.llm.arrays import text_slices
from quillmill.llm.bpe_core import DEFAULT_VOCAB, Ranks
from quillmill.llm.shared import read_table, type_of


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocab: str = DEFAULT_VOCAB) -> DataFrame:
    """(doc_id, n_tokens) of every row."""

    def count(batches):
        ranks = Ranks.load(vocab)
        for batch in batches:
            got = [ranks.count_slice(buf, offs) for _, _, buf, offs in text_slices(batch, "text")]
            n = np.concatenate(got) if got else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return src.mapInArrow(count, f"doc_id {type_of(src, 'doc_id')}, n_tokens bigint")


QUERIES = {"op6_token_counts": lambda spark, sf_dir: token_counts(read_table(spark, sf_dir, "documents"))}
ORACLE: dict[str, str] = {}
