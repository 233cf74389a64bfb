"""Operators of a training-data pipeline.

``queries()`` and ``oracle_sql()`` gather what the modules of this package
register.  Nothing outside the package imports it but the entry module.
"""

from __future__ import annotations

MODULES = (
    "chat_prefix",
    "embedding_dedup",
    "simhash_dedup",
    "language_id",
    "token_store",
    "token_counts",
    "quality_rules",
    "bpe_codec",
    "pii_anchors",
    "source_mixing",
)


def _modules():
    from importlib import import_module

    return [import_module(f"{__name__}.{m}") for m in MODULES]


def queries() -> dict:
    out: dict = {}
    for m in _modules():
        out.update(m.QUERIES)
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for m in _modules():
        out.update(m.ORACLE)
    return out
