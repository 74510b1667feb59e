"""Reading order and text of OCR tokens."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

LINE_GAP = 15


def reading_order(tokens: DataFrame, key: Sequence[str] = ("image_id",),
                  gap: int = LINE_GAP) -> DataFrame:
    """Add ``line`` and ``rank``: top to bottom, left to right within a line.

    A token starts a new line when it stands more than ``gap`` pixels below the one
    before. The unit is one image, so a window never holds more than one page.
    """
    by_y = Window.partitionBy(*key).orderBy("bbox.y", "bbox.x", "text")
    by_line = Window.partitionBy(*key).orderBy("line", "bbox.x", "bbox.y", "text")
    down = F.coalesce(F.col("bbox.y") - F.lag("bbox.y").over(by_y) > gap, F.lit(False))
    return (tokens.withColumn("_down", down.cast("int"))
            .withColumn("line", F.sum("_down").over(by_y.rowsBetween(
                Window.unboundedPreceding, 0))).drop("_down")
            .withColumn("rank", F.row_number().over(by_line)))


def image_text(ordered: DataFrame, key: Sequence[str] = ("image_id",)) -> DataFrame:
    """Text of each image, one token per line, and the mean confidence to one digit."""
    token = F.array_sort(F.collect_list(F.struct("rank", F.col("text").alias("t"))))
    return ordered.groupBy(*key).agg(
        F.array_join(F.transform(token, lambda t: t["t"]), "\n").alias("text"),
        F.round(F.avg("confidence"), 1).alias("confidence"),
        F.count("*").alias("n_tokens"))
