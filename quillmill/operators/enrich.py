"""Calls to an enrichment service from the executors, with retries."""

from __future__ import annotations

import re
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

_LIMITED = re.compile(r"\b429\b|\brate\b", re.IGNORECASE)


def with_retries(call: Callable[[list[str]], list[str]], texts: list[str], retries: int = 3, base_delay: float = 1.0, sleep=time.sleep) -> list[str]:
    """Call again after a rate-limit error, waiting twice as long each time; other errors end it at once."""
    for attempt in range(retries):
        try:
            return call(texts)
        except Exception as error:  # the client's own error types aren't known here
            if not _LIMITED.search(str(error)) or attempt == retries - 1:
                raise RuntimeError(f"enrichment failed: {error}") from error
            sleep(base_delay * 2**attempt)
    raise RuntimeError("enrichment failed: no attempt was allowed")


def enrich(docs: DataFrame, make_client: Callable[[], Callable[[list[str]], list[str]]], least_chars: int = 0, concurrency: int = 8, batch: int = 16, retries: int = 3, base_delay: float = 1.0) -> DataFrame:
    """(document_id, json, error) of the documents that aren't too short.

    ``make_client`` is called once a partition and gives a function from texts
    to JSON results; ``concurrency`` partitions call at the same time.
    """

    def run(batches):
        call = make_client()
        for pdf in batches:
            for k in range(0, len(pdf), batch):
                part = pdf.iloc[k : k + batch]
                try:
                    out, error = with_retries(call, part["text"].tolist(), retries, base_delay), None
                except RuntimeError as failure:
                    out, error = [None] * len(part), str(failure)
                yield pd.DataFrame({"document_id": part["document_id"].tolist(), "json": out, "error": [error] * len(part)})

    long = docs.filter(F.length("text") >= least_chars).select("document_id", "text")
    return long.repartition(concurrency).mapInPandas(run, "document_id string, json string, error string")
