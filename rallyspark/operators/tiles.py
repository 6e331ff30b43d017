"""Frames near one another meet in a tile of a clip, so that tasks grow with neither clips nor spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: frames of a tile
TILE = 100_000


def tiled(rows: DataFrame, first: Column, last: Column) -> DataFrame:
    """The rows once per tile of a clip that their frames ``first`` to ``last`` touch, with the tile; empty or unknown spans stay once, without one."""
    at = lambda frame: F.floor(frame.cast("long") / TILE)
    return rows.withColumn("tile_", F.explode_outer(F.when(first <= last, F.sequence(at(first), at(last)))))


def in_spans(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``rows(clip_id, frame, ...)`` with in_: whether a span (``clip_id, start_frame, end_frame``, ends included) holds the frame.
    Spans and rows meet in one ordered pass per tile, so that neither a span's length nor a clip's costs."""
    marks = tiled(spans.select("clip_id", F.col("start_frame").alias("frame"), F.col("end_frame").alias("end_")), F.col("frame"), F.col("end_")).filter("tile_ is not null")
    both = marks.withColumn("mark_", F.lit(True)).unionByName(tiled(rows, F.col("frame"), F.col("frame")).withColumn("mark_", F.lit(False)), allowMissingColumns=True)
    upto = Window.partitionBy("clip_id", "tile_").orderBy("frame", F.desc("mark_")).rowsBetween(Window.unboundedPreceding, 0)
    inside = F.coalesce(F.max("end_").over(upto) >= F.col("frame"), F.lit(False))
    return both.withColumn("in_", inside).filter("not mark_").select(*rows.columns, "in_")
