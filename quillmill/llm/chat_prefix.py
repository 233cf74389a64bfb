"""Prefix-target expansion of conversations.

Every assistant turn becomes its own example: all turns before it are the
context, its own reply is the only trainable part, given as a character span
of the rendered example.  One shuffle on the conversation id; the turns of a
conversation are ordered by (turn, role, text), so ties and repeated rows have
a fixed order.

Defined cases: a null turn number sorts first; a null role counts as the
empty role and is no assistant; a null text is rendered as empty; turns with a
null conversation id belong to no conversation and are left out; an assistant
turn without a turn before it has an empty context; very long texts stand whole
in every example that they are context of; ids keep their type; an empty table
gives an empty result; other columns of the input are never looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillmill.llm.shared import read_table

#: A turn is written as head + role + middle + text + tail.
TEMPLATE = ("<|", "|>\n", "\n")
TARGET_ROLE = "assistant"


def prefix_targets(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", template: tuple[str, str, str] = TEMPLATE, target_role: str = TARGET_ROLE) -> DataFrame:
    """(conv_id, example, turn, n_context, context, target, text, train_start, train_end), one row an assistant turn.

    ``text`` is context + target; the trainable characters are
    ``[train_start, train_end)`` of it: the reply and the tail that ends it.
    """
    head, middle, tail = template
    src = turns.select(
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).cast("bigint").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
    ).filter(F.col("conv_id").isNotNull())
    grouped = src.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    # only conversations with a reply are expanded
    some = grouped.filter(F.exists("turns", lambda t: t["role"] == target_role))
    each = some.select("conv_id", "turns", F.posexplode("turns").alias("at", "reply")).filter(F.col("reply.role") == target_role)
    context = F.array_join(
        F.transform(F.slice("turns", F.lit(1), F.col("at")), lambda t: F.concat(F.lit(head), t["role"], F.lit(middle), t["text"], F.lit(tail))),
        "",
    )
    lead = F.lit(f"{head}{target_role}{middle}")
    out = each.select(
        "conv_id",
        F.col("at").cast("bigint").alias("example"),
        F.col("reply.turn").alias("turn"),
        F.col("at").cast("bigint").alias("n_context"),
        context.alias("context"),
        F.concat(F.col("reply.text"), F.lit(tail)).alias("target"),
    )
    return out.select(
        "*",
        F.concat("context", lead, "target").alias("text"),
        (F.length("context") + F.length(lead)).cast("bigint").alias("train_start"),
        (F.length("context") + F.length(lead) + F.length("target")).cast("bigint").alias("train_end"),
    )


QUERIES = {"op1_prefix_targets": lambda spark, sf_dir: prefix_targets(read_table(spark, sf_dir, "conversations"))}
ORACLE = {
    "op1_prefix_targets": """
WITH t AS (
  SELECT conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT *, coalesce(string_agg('<|' || role || '|>' || chr(10) || text || chr(10), '')
    OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS context FROM t)
SELECT conv_id, CAST(pos AS BIGINT) AS example, turn, CAST(pos AS BIGINT) AS n_context, context, text || chr(10) AS target,
       context || '<|assistant|>' || chr(10) || text || chr(10) AS text,
       CAST(length(context) + 14 AS BIGINT) AS train_start,
       CAST(length(context) + 14 + length(text) + 1 AS BIGINT) AS train_end
FROM c WHERE role = 'assistant'
"""
}
