"""Small page rasters, drawn from document ids."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F


def page_with_boxes(boxes: int, width: int, height: int) -> bytes:
    page = np.full((height, width), 255, np.uint8)
    for i in range(boxes):
        page[5 + 18 * i : 13 + 18 * i, 10 : 10 + 12 + i] = 0
    return page.tobytes()


def pages_with_boxes(docs: DataFrame, width: int = 80, height: int = 60) -> DataFrame:
    """(document_id, page_number, width, height, pixels): doc_id % 4 dark boxes on a white page.

    Only four pages differ, so they are drawn once and handed out by the JVM: in Python, a batch of 10,000 ids became 48 MB of pixels.
    """
    drawn = F.array(*[F.lit(page_with_boxes(k, width, height)) for k in range(4)])
    # a row without an id has no page
    pixels = F.when(F.col("doc_id").isNotNull(), F.element_at(drawn, (F.pmod("doc_id", F.lit(4)) + 1).cast("int")))
    return docs.select("document_id", F.lit(0).alias("page_number"), F.lit(width).alias("width"), F.lit(height).alias("height"), pixels.alias("pixels"))
