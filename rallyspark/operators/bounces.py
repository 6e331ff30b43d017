"""Bounces from the picture's y, smoothed over gaps, and from reconstructed heights.

Windows whose length is a column of scaled_params() run over frames in units of that length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import bbox_distance, in_court_call, project, speed_change, turn_degrees, zone
from ..sources.readers import written
from .ball import KNOWN, W
from .chain import rate
from .helpers import refractory, suppress_neighbours
from .params import scaled_params
from .shots import between_shots, cap_per_interval, exclude_near

#: Feet outside the court beyond which nothing bounces, and the factor of a bounce at a player's feet.
MOST_OUT_FT, AT_FEET = 8.0, 0.7
#: Feet of height at the floor, before and after a bounce, rows to look for them, seconds between bounces.
FLOOR_FT, ARRIVE_FT, DEPART_FT, LOOK_ROWS, APART_S = 0.35, 1.0, 0.5, 15, 0.30
#: Parts of a window's length in which frames are counted, and parts that rounding may take.
_UNIT, _EDGE = 1_000_000, 10


def within(length: str, before: int, after: int, own: bool = True):
    """Rows from ``before`` to ``after`` lengths away (-1, 0 or 1); without ``own`` not the row itself."""
    w = Window.partitionBy("clip_id").orderBy(F.round(F.col("frame").cast("long") * _UNIT / F.col(length)).cast("long"))
    edge = -_EDGE if own else _EDGE
    return w.rangeBetween(-_UNIT - _EDGE if before else edge, _UNIT + _EDGE if after else -edge)


def smoothed(ball: DataFrame, params: DataFrame) -> DataFrame:
    """The ball's rows with ``known``, ``filled`` (y by straight lines over gaps, held at the ends) and ``ys``, its mean over three
    rows with zeros beyond the ends. Clips with fewer than two known frames have neither."""
    known = KNOWN() & F.col("pixel_y").isNotNull()
    rows = ball.join(params, "clip_id").withColumn("known", F.coalesce(known, F.lit(False)))
    here = F.when(F.col("known"), F.struct("frame", F.col("pixel_y").alias("y")))
    back = Window.partitionBy("clip_id").orderBy(F.desc("frame")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"p": F.last(here, ignorenulls=True).over(W().rowsBetween(Window.unboundedPreceding, 0)), "n": F.last(here, ignorenulls=True).over(back), "n_known": F.count_if("known").over(Window.partitionBy("clip_id"))})
    line = F.col("p.y") + (F.col("n.y") - F.col("p.y")) * (F.col("frame") - F.col("p.frame")) / (F.col("n.frame") - F.col("p.frame"))
    filled = F.when(F.col("known"), F.col("pixel_y")).when(F.col("p").isNull(), F.col("n.y")).when(F.col("n").isNull(), F.col("p.y")).otherwise(line)
    rows = rows.withColumn("filled", F.when(F.col("n_known") >= 2, filled)).drop("p", "n", "n_known")
    beside = lambda c: F.coalesce(c, F.lit(0.0))
    return rows.withColumn("ys", (beside(F.lag("filled").over(W())) + F.col("filled") + beside(F.lead("filled").over(W()))) / 3)


def candidates(series: DataFrame) -> DataFrame:
    """Frames of smoothed() where ys is largest within an impact window, with enough descent before and rebound after and a known
    frame within two rows: clip_id, frame, score (the smaller of both)."""
    ends = Window.partitionBy("clip_id")
    rows = series.withColumns({
        "top": F.max("ys").over(within("impact_window", -1, 1)), "low_before": F.min("ys").over(within("impact_window", -1, 0, False)), "low_after": F.min("ys").over(within("impact_window", 0, 1, False)),
        "near": F.max("known").over(W().rowsBetween(-2, 2)), "lo": F.min("frame").over(ends), "hi": F.max("frame").over(ends)})
    fall, rise = F.col("ys") - F.col("low_before"), F.col("ys") - F.col("low_after")
    inside = (F.col("frame") - F.col("lo") >= F.col("impact_window")) & (F.col("hi") - F.col("frame") >= F.col("impact_window"))
    good = inside & (F.col("ys") >= F.col("top") - 1e-9) & (fall >= F.col("bounce_prominence_px")) & (rise >= F.col("bounce_prominence_px")) & F.col("near")
    return rows.filter(good).select("clip_id", "frame", F.least(fall, rise).alias("score"))


def flips(series: DataFrame) -> DataFrame:
    """Whether ys falls into and rises out of each frame by more than the floor per frame, measured over a velocity window on
    either side: clip_id, frame, flip (null at the clip's ends)."""
    first = lambda c: F.first(c).over(within("velocity_window", -1, 0))
    last = lambda c: F.last(c).over(within("velocity_window", 0, 1))
    rows = series.withColumns({"f0": first("frame"), "y0": first("ys"), "f1": last("frame"), "y1": last("ys")})
    down, up = F.try_divide(F.col("ys") - F.col("y0"), F.col("frame") - F.col("f0")), F.try_divide(F.col("y1") - F.col("ys"), F.col("f1") - F.col("frame"))
    return rows.select("clip_id", "frame", F.when(down.isNotNull() & up.isNotNull(), (down > F.col("flip_floor")) & (up < -F.col("flip_floor"))).alias("flip"))


def nearest_box(events: DataFrame, players: DataFrame) -> DataFrame:
    """``events(clip_id, frame, x, y, assoc_*)`` with the nearest box on their frame (ties: smaller track), its distance and radius."""
    d = bbox_distance(F.col("x"), F.col("y"), *[F.col(f"bbox_{c}") for c in ("x1", "y1", "x2", "y2")])
    radius = F.least(F.greatest(0.5 * F.greatest(F.lit(1.0), F.col("bbox_y2") - F.col("bbox_y1")), F.col("assoc_min_px")), F.col("assoc_max_px"))
    rows = events.select("clip_id", "frame", "x", "y", "assoc_min_px", "assoc_max_px").join(players.filter("not transient").select("clip_id", "frame", "track_id", *[f"bbox_{c}" for c in ("x1", "y1", "x2", "y2")]), ["clip_id", "frame"])
    best = rows.groupBy("clip_id", "frame").agg(F.min(F.struct(d.alias("d"), "track_id", radius.alias("radius"))).alias("b"))
    return events.join(best, ["clip_id", "frame"], "left").select(*events.columns, F.col("b.d").alias("player_px"), F.col("b.track_id").alias("near_track"), F.col("b.radius").alias("radius"))


def _impulse(rows: DataFrame) -> DataFrame:
    """Adds turn and ratio of each frame from the steps to its neighbours."""
    step = lambda c, to: (F.lead(c).over(W()) - F.col(c)) if to else (F.col(c) - F.lag(c).over(W()))
    ax, ay, bx, by = step("x", 0), step("y", 0), step("x", 1), step("y", 1)
    return rows.withColumns({"ax": ax, "ay": ay, "bx": bx, "by": by}).withColumns({"turn": turn_degrees(*[F.col(c) for c in ("ax", "ay", "bx", "by")]), "ratio": speed_change(*[F.col(c) for c in ("ax", "ay", "bx", "by")])})


def _speeds(rows: DataFrame) -> DataFrame:
    """Adds before and after: the nearest known places within a velocity window."""
    here = F.when(F.col("known"), F.struct("frame", "x", "y"))
    back = Window.partitionBy("clip_id").orderBy(F.desc("frame"))
    near = lambda s: F.when(F.abs(F.col(f"{s}.frame") - F.col("frame")) <= F.col("velocity_window"), F.col(s))
    return rows.withColumns({"p_": F.last(here, ignorenulls=True).over(W().rowsBetween(Window.unboundedPreceding, -1)), "n_": F.last(here, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))}).withColumns({"before": near("p_"), "after": near("n_")})


def detect_bounces(ball: DataFrame, players: DataFrame, shots: DataFrame, court: DataFrame) -> DataFrame:
    """Bounces of each clip: candidates away from shots, the strongest of neighbours, with a flip of the vertical direction where a
    player is near (everywhere on real balls), moved to the ground contact, placed on the court, at most one between two shots.

    ``court`` has the homography, fps, frame_width and real. A turn that is unknown counts as a sharp one. Candidates on frames
    without a ball go, since they can't be placed."""
    params = scaled_params(court).join(court.select("clip_id", "real"), "clip_id")
    series = smoothed(ball, params).withColumns({"x": F.when(F.col("known"), F.col("pixel_x")), "y": F.when(F.col("known"), F.col("pixel_y"))})
    series = written(_speeds(_impulse(series)).withColumn("quality", F.avg(F.coalesce("visible", F.lit(False)).cast("int")).over(within("impact_window", -1, 1))))
    widths = params.select("clip_id", "exclusion_window", "impact_window")
    free = exclude_near(candidates(series).join(widths, "clip_id"), shots, "exclusion_window").drop("exclusion_window")
    kept = written(suppress_neighbours(free, "impact_window").select("clip_id", "frame").join(series.filter("known"), ["clip_id", "frame"]))
    at = nearest_box(kept, players).withColumn("at_feet", F.coalesce(F.col("player_px") < F.col("radius"), F.lit(False))).join(flips(series), ["clip_id", "frame"])
    at = at.filter(F.coalesce("flip", F.lit(False)) | ~(F.col("at_feet") | F.col("real")))
    sharp = F.greatest(F.least(F.lit(1.0), F.coalesce(F.col("turn") / 120, F.lit(1.0))), F.least(F.lit(1.0), F.coalesce("ratio", F.lit(1.0))))
    close_to = F.least(F.lit(1.0), F.col("player_px") / F.col("radius"))
    found = at.select("clip_id", F.col("frame").alias("detected"), "velocity_window", "at_feet", "player_px", "near_track", sharp.alias("sharp"), F.when(F.col("at_feet"), 1 - close_to).otherwise(F.coalesce(close_to, F.lit(1.0))).alias("prox"))
    # The ground contact: the lowest place within a velocity window; the candidate's own frame wins ties, then the earliest.
    near = found.select("clip_id", "detected", F.explode(F.sequence(F.col("detected") - F.col("velocity_window"), F.col("detected") + F.col("velocity_window"))).alias("frame"))
    ground = near.join(series.filter("known").select("clip_id", "frame", "y"), ["clip_id", "frame"]).groupBy("clip_id", "detected").agg(F.min(F.struct((-F.col("y")).alias("y"), (F.col("frame") != F.col("detected")).alias("other"), "frame"))["frame"].alias("frame"))
    cells = [f"h{i}{j}" for i in range(3) for j in range(3)]
    rows = found.join(ground, ["clip_id", "detected"]).join(series.select("clip_id", "frame", "x", "y", "before", "after", "quality", "fps"), ["clip_id", "frame"]).join(court.select("clip_id", *cells), "clip_id")
    cx, cy = project(F.col("x"), F.col("y"))
    rows = rows.withColumns({"cx": cx, "cy": cy}).filter(F.col("cx").between(-MOST_OUT_FT, 20 + MOST_OUT_FT) & F.col("cy").between(-MOST_OUT_FT, 44 + MOST_OUT_FT))
    inside, side = in_court_call(F.col("cx"), F.col("cy"))
    confidence = F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.5 * F.col("sharp") + 0.3 * F.col("prox") + 0.2 * F.col("quality"))) * F.when(F.col("at_feet"), AT_FEET).otherwise(1.0)
    placed = rows.select("clip_id", "frame", F.round("x", 2).alias("pixel_x"), F.round("y", 2).alias("pixel_y"), F.round("cx", 2).alias("court_x_ft"), F.round("cy", 2).alias("court_y_ft"), inside.alias("is_in"), side.alias("out_side"),
                         F.when(inside, zone(F.col("cy"))).otherwise("out").alias("court_zone"), "at_feet", F.round("player_px", 2).alias("player_px"), F.when(F.col("at_feet"), F.col("near_track")).alias("track_id"),
                         F.round(F.hypot(*[rate("", "before", c) for c in "xy"]), 3).alias("speed_pre"), F.round(F.hypot(*[rate("after", "", c) for c in "xy"]), 3).alias("speed_post"), F.round(confidence, 3).alias("confidence"))
    numbered = written(placed.withColumn("bounce_id", (F.row_number().over(Window.partitionBy("clip_id").orderBy("frame", F.desc("confidence"))) - 1).cast("long")))
    linked = between_shots(numbered, shots).join(numbered.select("clip_id", "bounce_id", "confidence"), ["clip_id", "bounce_id"])
    held = cap_per_interval(linked).select("clip_id", "bounce_id", "prev_shot", "next_shot")
    out = numbered.join(held, ["clip_id", "bounce_id"])
    return out.withColumn("bounce_id", (F.row_number().over(Window.partitionBy("clip_id").orderBy("frame", "bounce_id")) - 1).cast("long"))


def bounces_from_height(ball_3d: DataFrame, court: DataFrame) -> DataFrame:
    """Bounces where the reconstructed ball touches the floor: a low that comes from ARRIVE_FT and goes to DEPART_FT within
    LOOK_ROWS rows, APART_S after the last one kept. ``ball_3d(clip_id, frame, x, y, z)``: rows, not frames, are neighbours."""
    back, ahead = W().rowsBetween(-LOOK_ROWS, -1), W().rowsBetween(1, LOOK_ROWS)
    rows = ball_3d.withColumns({"up_before": F.max("z").over(back), "up_after": F.max("z").over(ahead), "n_before": F.count("*").over(back), "n_after": F.count("*").over(ahead), "z0": F.lag("z").over(W()), "z1": F.lead("z").over(W())})
    low = (F.col("z") <= FLOOR_FT) & (F.col("z") <= F.col("z0")) & (F.col("z") <= F.col("z1")) & (F.col("up_before") >= ARRIVE_FT) & (F.col("up_after") >= DEPART_FT) & (F.col("n_before") == LOOK_ROWS) & (F.col("n_after") == LOOK_ROWS)
    touch = rows.filter(low).join(court.select("clip_id", "fps"), "clip_id").select(F.col("clip_id").cast("long"), F.col("frame").cast("long"), (F.col("frame") / F.col("fps")).alias("t"), F.col("x").alias("court_x_ft"), F.col("y").alias("court_y_ft"), F.col("z").alias("z_ft"))
    return refractory(touch, APART_S, "t").drop("t")
