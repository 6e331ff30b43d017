"""The ball's series, one ordered pass per clip: every window is partitioned by clip and ordered by frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import in_rect, project, speed_change, turn_degrees
from .tiles import in_spans


def W():  # noqa: N802
    """A clip's frames in order."""
    return Window.partitionBy("clip_id").orderBy("frame")

def KNOWN():  # noqa: N802
    return F.expr("visible or interpolated")


def check_ball(ball: DataFrame) -> DataFrame:
    """Violations of the series' invariants per clip."""
    gap = F.col("frame") - F.coalesce(F.lag("frame").over(W()), F.lit(-1)) != 1
    return ball.withColumn("gap", gap).groupBy("clip_id").agg(
        F.count_if(F.expr("visible and interpolated")).alias("both_flags"), F.count_if(KNOWN() & (F.col("pixel_x").isNull() | F.col("pixel_y").isNull())).alias("known_without_xy"),
        F.count_if(~KNOWN() & (F.col("pixel_x").isNotNull() | F.col("pixel_y").isNotNull())).alias("unknown_with_xy"), F.count_if("gap").alias("frame_gaps"),
        F.count_if(F.col("confidence").isNotNull() != F.col("visible")).alias("confidence_mismatch"))


def drop_outliers(dets: DataFrame, per_frame: float = 250.0) -> DataFrame:
    """Detections further than ``per_frame`` times the gap from every neighbour that exists go."""
    def far(step):
        other = lambda c: F.lag(c, step).over(W()) if step > 0 else F.lead(c, -step).over(W())
        return F.hypot(F.col("pixel_x") - other("pixel_x"), F.col("pixel_y") - other("pixel_y")) > per_frame * F.abs(F.col("frame") - other("frame"))

    back, ahead = far(1), far(-1)
    gone = (F.coalesce(back, F.lit(True)) & F.coalesce(ahead, F.lit(True))) & (back.isNotNull() | ahead.isNotNull())
    return dets.withColumn("gone", gone).filter("not gone").drop("gone")


def fill_gaps(ball: DataFrame, longest: int = 8) -> DataFrame:
    """One row per frame: visible, linearly interpolated across gaps of 2..``longest`` frames, or missing."""
    seen = lambda: F.when(F.col("visible"), F.struct("frame", "pixel_x", "pixel_y"))
    last = F.last(seen(), ignorenulls=True).over(W().rowsBetween(Window.unboundedPreceding, 0))
    nxt = F.last(seen(), ignorenulls=True).over(Window.partitionBy("clip_id").orderBy(F.desc("frame")).rowsBetween(Window.unboundedPreceding, 0))  # backwards, so that the frame only grows
    out = ball.select("clip_id", "frame", "visible", "pixel_x", "pixel_y", last.alias("a"), nxt.alias("b"))
    span = F.col("b.frame") - F.col("a.frame")
    fill = ~F.col("visible") & span.between(2, longest)
    t = (F.col("frame") - F.col("a.frame")) / span
    mid = lambda c: F.when(F.col("visible"), F.col(c)).when(fill, F.col(f"a.{c}") + (F.col(f"b.{c}") - F.col(f"a.{c}")) * t)
    return out.select("clip_id", "frame", F.when(F.col("visible"), "visible").when(fill, "interpolated").otherwise("missing").alias("state"), mid("pixel_x").alias("x"), mid("pixel_y").alias("y"))


def drop_teleports(ball: DataFrame, most: float = 300.0) -> DataFrame:
    """Left to right, a frame goes when the frame before it stays and lies further than ``most``: in a chain of such
    steps that is the first, third, fifth."""
    bad = F.coalesce(F.hypot(F.col("pixel_x") - F.lag("pixel_x").over(W()), F.col("pixel_y") - F.lag("pixel_y").over(W())) > most, F.lit(False))
    chains = ball.withColumn("bad", bad).withColumn("chain", F.sum(F.when(F.col("bad"), 0).otherwise(1)).over(W().rowsBetween(Window.unboundedPreceding, 0)))
    place = F.sum(F.col("bad").cast("int")).over(Window.partitionBy("clip_id", "chain").orderBy("frame").rowsBetween(Window.unboundedPreceding, 0))
    return chains.withColumn("dropped", F.col("bad") & (place % 2 == 1)).drop("bad", "chain")


def velocity(ball: DataFrame) -> DataFrame:
    """Speed, turn and speed change at frames known on both sides."""
    x, y = F.col("pixel_x"), F.col("pixel_y")
    steps = ball.select("clip_id", "frame", (x - F.lag(x).over(W())).alias("ax"), (y - F.lag(y).over(W())).alias("ay"), (F.lead(x).over(W()) - x).alias("bx"), (F.lead(y).over(W()) - y).alias("by"))
    a, b = (F.col("ax"), F.col("ay")), (F.col("bx"), F.col("by"))
    return steps.filter("ax is not null and bx is not null").select(
        "clip_id", "frame", F.hypot(*a).alias("speed_in"), F.hypot(*b).alias("speed_out"), turn_degrees(*a, *b).alias("turn"), speed_change(*a, *b).alias("speed_ratio"))


def windowed_velocity(ball: DataFrame, k: int = 5) -> DataFrame:
    """Velocity to the nearest known neighbour within k frames on either side, and the turn between them."""
    here = F.when(KNOWN(), F.struct("frame", "pixel_x", "pixel_y"))
    a = F.last(here, ignorenulls=True).over(W().rowsBetween(-k, -1))
    b = F.first(here, ignorenulls=True).over(W().rowsBetween(1, k))
    rows = ball.select("clip_id", "frame", "pixel_x", "pixel_y", KNOWN().alias("known"), a.alias("a"), b.alias("b")).filter("known and a is not null and b is not null")
    rate = lambda c, p, q: (F.col(f"{q}{c}") - F.col(f"{p}{c}")) / (F.col(f"{q}frame") - F.col(f"{p}frame"))
    vin, vout = [rate(c, "a.", "") for c in ("pixel_x", "pixel_y")], [rate(c, "", "b.") for c in ("pixel_x", "pixel_y")]
    return rows.select("clip_id", "frame", vin[0].alias("vx_in"), vin[1].alias("vy_in"), vout[0].alias("vx_out"), vout[1].alias("vy_out"), turn_degrees(*vin, *vout).alias("turn"))


def known_runs(ball: DataFrame) -> DataFrame:
    """Runs of known and of unknown frames with the length of the run before."""
    k = ball.select("clip_id", "frame", KNOWN().alias("known"))
    change = F.coalesce((F.col("known") != F.lag("known").over(W())).cast("int"), F.lit(0))
    runs = k.withColumn("change", change).withColumn("run", F.sum("change").over(W().rowsBetween(Window.unboundedPreceding, 0)))
    out = runs.groupBy("clip_id", "run", "known").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("length"))
    return out.withColumn("gap_before", F.lag("length").over(Window.partitionBy("clip_id").orderBy("start_frame"))).drop("run")


def jump_into_run(ball: DataFrame) -> DataFrame:
    """Pixels per frame from the last known ball before a known run to its first frame."""
    known = ball.filter(KNOWN())
    step = known.withColumn("before", F.lag(F.struct("frame", "pixel_x", "pixel_y")).over(W())).filter("frame - before.frame > 1")
    return step.select("clip_id", "frame", (F.hypot(F.col("pixel_x") - F.col("before.pixel_x"), F.col("pixel_y") - F.col("before.pixel_y")) / (F.col("frame") - F.col("before.frame"))).alias("jump"))


def max_jump(events: DataFrame, ball: DataFrame, half: int = 30) -> DataFrame:
    """Largest step per frame between consecutive known frames that both lie within ``half`` of an event.

    Steps are joined by clip and frame bucket, so an event meets the steps of three buckets only.
    """
    steps = (ball.filter(KNOWN()).withColumn("p", F.lag(F.struct("frame", "pixel_x", "pixel_y")).over(W())).filter("p is not null")
             .select("clip_id", F.col("frame").alias("f1"), F.col("p.frame").alias("f0"),
                     (F.hypot(F.col("pixel_x") - F.col("p.pixel_x"), F.col("pixel_y") - F.col("p.pixel_y")) / (F.col("frame") - F.col("p.frame"))).alias("step"), F.floor(F.col("frame") / half).alias("bucket")))
    near = events.select("clip_id", F.col("frame").alias("at")).withColumn("bucket", F.explode(F.sequence(F.floor((F.col("at") - half) / half), F.floor((F.col("at") + half) / half))))
    return (near.join(steps, ["clip_id", "bucket"]).filter((F.col("f0") >= F.col("at") - half) & (F.col("f1") <= F.col("at") + half))
            .groupBy("clip_id", F.col("at").alias("frame")).agg(F.max("step").alias("max_jump")))


def grounded_fraction(ball: DataFrame, court: DataFrame, half: int = 15, margin: float = 8.0, least: int = 6) -> DataFrame:
    """Share of known frames within ``half`` whose ground point lies within ``margin`` feet of the court."""
    x, y = project(F.col("pixel_x"), F.col("pixel_y"))
    w = W().rangeBetween(-half, half)
    rows = ball.join(court, "clip_id").withColumn("near_", F.when(KNOWN(), in_rect(x, y, margin, margin).cast("int")))
    return rows.select("clip_id", "frame", F.when(F.count("near_").over(w) >= least, F.avg("near_").over(w)).alias("grounded"))


def visibility(ball: DataFrame, half: int = 15) -> DataFrame:
    return ball.select("clip_id", "frame", F.avg(F.col("visible").cast("int")).over(W().rangeBetween(-half, half)).alias("visibility"))


def coverage(ball: DataFrame, low: float = 0.30) -> DataFrame:
    share = lambda c: F.avg(F.expr(c).cast("int"))
    return ball.groupBy("clip_id").agg(share("visible").alias("visible_share"), share("interpolated").alias("interpolated_share"), share("not (visible or interpolated)").alias("none_share"),
                                       (share("visible") < low).alias("low_coverage"))


def gap_stats(ball: DataFrame, long_gap: int = 4) -> DataFrame:
    """Runs of frames without a visible ball: count, median, ninth decile, longest, and how many are long."""
    v = ball.withColumn("change", F.coalesce((F.col("visible") != F.lag("visible").over(W())).cast("int"), F.lit(0)))
    runs = v.withColumn("run", F.sum("change").over(W().rowsBetween(Window.unboundedPreceding, 0))).filter("not visible").groupBy("clip_id", "run").agg(F.count("*").alias("n"))
    return runs.groupBy("clip_id").agg(F.count("*").alias("n_gaps"), F.percentile("n", F.lit(0.5)).alias("median_gap"), F.percentile("n", F.lit(0.9)).alias("p90_gap"),
                                       F.max("n").alias("longest_gap"), F.count_if(F.col("n") >= long_gap).alias("long_gaps"))


def roi_filter(dets: DataFrame, court: DataFrame, least: float = 0.3, margin: float = 8.0) -> DataFrame:
    """Counts per clip of detections under the threshold, outside the grown court, and kept."""
    x, y = project(F.col("pixel_x"), F.col("pixel_y"))
    low = F.col("confidence") < least
    inside = in_rect(x, y, margin, margin)
    return dets.filter("visible").join(court, "clip_id").groupBy("clip_id").agg(
        F.count_if(low).alias("low_confidence"), F.count_if(~low & ~inside).alias("outside"), F.count_if(~low & inside).alias("kept"))


def live_play_rate(ball: DataFrame, rallies: DataFrame) -> DataFrame:
    """Share of frames inside rallies where the ball is known."""
    return in_spans(ball.select("clip_id", "frame", "visible", "interpolated"), rallies).filter("in_").groupBy("clip_id").agg(F.count("*").alias("frames"), F.avg(KNOWN().cast("int")).alias("known_share"))
