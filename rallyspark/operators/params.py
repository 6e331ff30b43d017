"""Thresholds per clip, from its frame width and rate, and checks of versions and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pixels at 1920 pixels of width, frames at 30 frames a second, and seconds.
PIXELS = {"assoc_max_px": 120.0, "assoc_min_px": 30.0, "min_ball_speed": 1.5, "max_ball_speed": 400.0, "excursion_px": 600.0, "teleport_px": 40.0, "latch_px": 75.0,
          "bounce_prominence_px": 9.0, "flip_px": 2.0, "flip_floor": 0.3, "rebound_px": 20.0, "descent_px": 14.0}
FRAMES = {"impact_window": 6, "velocity_window": 3, "exclusion_window": 3, "arc_frames": 45, "after_frames": 15}
SECONDS = {"serve_gap": 0.7, "rally_gap": 6.0, "handling_reset": 3.0, "handling_spread": 8.0, "latch_window": 1.0, "serve_dedup": 2.0, "open_gap": 3.0, "return_frames": 2.5,
           "dead_gap": 3.0, "inter_serve": 10.0, "grounded_window": 1.0}


def scaled_params(court: DataFrame) -> DataFrame:
    """One row per clip: pixel thresholds by width, frame windows (one at least) by frame rate, seconds as frames."""
    scale, rate = F.coalesce(F.col("frame_width"), F.lit(1920)) / 1920, F.col("fps") / 30
    whole = lambda c: F.bround(c).cast("int")  # noqa: E731  halves go to even
    return court.select("clip_id", "fps", *[(v * scale).alias(k) for k, v in PIXELS.items()], *[F.greatest(F.lit(1), whole(v * rate)).alias(k) for k, v in FRAMES.items()],
                        *[whole(v * F.col("fps")).alias(k) for k, v in SECONDS.items()], F.greatest(F.lit(2), whole(0.13 * F.col("fps"))).alias("min_serve_run"))


def check_schema_version(docs: DataFrame, expected: int, most: float = 0.5) -> DataFrame:
    """Clips whose documents can't be used together: another version, no frame rate, or rates of two sources too far apart.

    ``docs(clip_id, source, schema_version, fps)``; one row per clip with the first fault found."""
    of = docs.groupBy("clip_id").agg(F.count_if(~F.col("schema_version").eqNullSafe(F.lit(expected))).alias("wrong"), F.count_if(F.coalesce(F.col("fps") <= 0, F.lit(True))).alias("no_fps"),
                                     (F.max("fps") - F.min("fps")).alias("apart"))
    fault = F.when(F.col("wrong") > 0, "version").when(F.col("no_fps") > 0, "no frame rate").when(F.col("apart") > most, "frame rates differ")
    return of.withColumn("fault", fault).filter("fault is not null").select("clip_id", "fault")


def check_labels(labels: DataFrame, clips: DataFrame, least: int = 0) -> DataFrame:
    """Violations of label rows, one row each: (clip_id, frame, fault).

    ``labels(clip_id, seq, frame, ball_visible, label_x, label_y)`` in the order of ``seq``; ``clips(clip_id, n_frames,
    frame_width, frame_height)``. A clip with fewer than ``least`` labels has a row without a frame."""
    rows = labels.withColumn("before", F.lag("frame").over(Window.partitionBy("clip_id").orderBy("seq"))).join(clips, "clip_id")
    has = F.col("label_x").isNotNull() | F.col("label_y").isNotNull()
    lacks = F.col("label_x").isNull() | F.col("label_y").isNull()
    outside = ~(F.col("label_x").between(0, F.col("frame_width") - 1e-9) & F.col("label_y").between(0, F.col("frame_height") - 1e-9))

    def fault(name: str, test: Column) -> Column:
        return F.when(F.coalesce(test, F.lit(False)), name)

    faults = F.filter(F.array(
        fault("missing field", F.col("frame").isNull() | F.col("ball_visible").isNull()), fault("negative frame", F.col("frame") < 0), fault("not increasing", F.col("frame") <= F.col("before")),
        fault("past the end", F.col("frame") >= F.col("n_frames")), fault("visible without place", F.col("ball_visible") & lacks), fault("place without ball", ~F.col("ball_visible") & has),
        fault("outside the picture", F.col("ball_visible") & outside)), lambda x: x.isNotNull())
    few = clips.join(labels.groupBy("clip_id").agg(F.count("*").alias("n")), "clip_id", "left").filter(F.coalesce("n", F.lit(0)) < least)
    return rows.select("clip_id", "frame", F.explode(faults).alias("fault")).unionByName(few.select("clip_id", F.lit(None).cast(labels.schema["frame"].dataType).alias("frame"), F.lit("too few labels").alias("fault")))
