"""Quality verification: structure, weak signals, overall status."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from quillmill.functions import text as X


@dataclass(frozen=True)
class VerifyRules:
    required: tuple[str, ...] = field(default=("document_id", "source_path", "text"))
    least_confidence: float = 0.7
    most_garbled: float = 0.3
    most_redaction: float = 0.05
    most_pages: int = 200
    fail_ratio: float = 0.15


def flatten_metadata(df: DataFrame) -> DataFrame:
    """Lift ``metadata.confidence`` and ``metadata.page_count`` to the top, where the scan looks for them."""
    kind = dict(df.dtypes).get("metadata", "")
    for name in ("confidence", "page_count"):
        if name not in df.columns and f"{name}:" in kind:
            df = df.withColumn(name, F.col(f"metadata.{name}"))
    return df


def _structure(df: DataFrame, rules: VerifyRules) -> dict:
    missing = sorted(set(rules.required) - set(df.columns))
    has = lambda c: c in df.columns
    zero = F.lit(0).cast("bigint")
    count_if = lambda c: F.coalesce(F.count_if(c), zero)
    # an id that is null counts as a value of its own
    keyed = F.struct(F.col("document_id")) if has("document_id") else None
    return {
        "missing_columns": F.lit(",".join(missing)),
        "duplicate_ids": F.count(F.lit(1)) - F.countDistinct(keyed) if keyed is not None else zero,
        "bad_confidence": count_if((F.col("confidence") < 0) | (F.col("confidence") > 1)) if has("confidence") else zero,
        "bad_page_count": count_if(F.col("page_count") < 0) if has("page_count") else zero,
        "total_docs": F.count(F.lit(1)),
    }


_PASSED = "missing_columns = '' AND duplicate_ids = 0 AND bad_confidence = 0 AND bad_page_count = 0"


def structural(df: DataFrame, rules: VerifyRules = VerifyRules()) -> DataFrame:
    """One row: missing columns, duplicate ids, values out of range, in a single pass."""
    return df.agg(*[c.alias(name) for name, c in _structure(df, rules).items()]).withColumn("structural_passed", F.expr(_PASSED))


def with_signals(df: DataFrame, rules: VerifyRules = VerifyRules()) -> DataFrame:
    col = lambda c: F.col(c) if c in df.columns else None
    return df.withColumn("signals", X.weak_signals(F.col("text"), col("confidence"), col("page_count"), rules.least_confidence, rules.most_garbled, rules.most_redaction, rules.most_pages))


def weak_signal_scan(df: DataFrame, rules: VerifyRules = VerifyRules()) -> DataFrame:
    """(document_id, signals, snippet) of the flagged rows."""
    return with_signals(df, rules).filter(F.size("signals") > 0).select("document_id", "signals", F.left(F.coalesce("text", F.lit("")), F.lit(200)).alias("snippet"))


def status(df: DataFrame, rules: VerifyRules = VerifyRules()) -> DataFrame:
    """One row: overall status, counts, in a single pass.  A structural failure decides before any scan counts."""
    flagged = F.coalesce(F.count_if(F.size("signals") > 0), F.lit(0)).alias("flagged")
    both = with_signals(df, rules).agg(*[c.alias(name) for name, c in _structure(df, rules).items()], flagged).withColumn("structural_passed", F.expr(_PASSED))
    ratio = F.when(F.col("total_docs") > 0, F.col("flagged") / F.col("total_docs")).otherwise(F.lit(0.0))
    overall = (
        F.when(~F.col("structural_passed"), "failed").when(F.col("flagged") == 0, "passed").when(ratio > rules.fail_ratio, "failed").otherwise("warning")
    )
    return both.select(overall.alias("overall_status"), "structural_passed", F.when(F.col("structural_passed"), F.col("flagged")).otherwise(F.lit(0)).cast("bigint").alias("flagged_count"), "total_docs")
