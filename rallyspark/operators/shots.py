"""Shot and bounce events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import bbox_distance, in_court_call, side_of_net, zone
from .ball import KNOWN, W, velocity


def CLIP():  # noqa: N802
    return Window.partitionBy("clip_id")


def impulse_candidates(ball: DataFrame, turn: float = 45.0, ratio: float = 0.35, floor: float = 5.0) -> DataFrame:
    """Frames where the ball turns or changes speed sharply; score is the larger of both, on 0..1."""
    v = velocity(ball).filter((F.greatest("speed_in", "speed_out") >= floor) & ((F.col("turn") >= turn) | (F.col("speed_ratio") >= ratio)))
    return v.select("clip_id", "frame", F.greatest(F.col("turn") / 180, F.least(F.lit(1.0), F.col("speed_ratio"))).alias("score"))


def associate(events: DataFrame, players: DataFrame, court: DataFrame, least: float = 30.0, most: float = 400.0) -> DataFrame:
    """Nearest player box on each event's frame, within a radius of half the box height held to ``least``..``most``."""
    d = bbox_distance(F.col("pixel_x"), F.col("pixel_y"), *[F.col(f"bbox_{c}") for c in ("x1", "y1", "x2", "y2")])
    near = events.join(players.filter("not transient"), ["clip_id", "frame"]).withColumn("d", d)
    radius = F.least(F.greatest(0.5 * (F.col("bbox_y2") - F.col("bbox_y1")), F.lit(least)), F.lit(most))
    pick = F.min(F.when(F.col("d") <= radius, F.struct("d", (~F.col("is_user")).alias("not_user"), "track_id")))
    return near.groupBy("clip_id", "frame").agg(pick.alias("p")).select("clip_id", "frame", F.col("p.track_id").alias("track_id"), F.col("p.d").alias("distance"))


def last_shot(rows: DataFrame, shots: DataFrame) -> DataFrame:
    """``rows(clip_id, frame, ...)`` with the last shot at or before them (ties: larger id) as shot_id and ``at``, and the one after
    that as next_shot and next_frame. Rows before a clip's first shot go. Shots and rows meet in one ordered pass per clip, so that
    long pauses cost nothing; shots after a clip's last row only bound the one before."""
    w = CLIP().orderBy("frame", "shot_id")
    ends = rows.groupBy("clip_id").agg(F.max("frame").alias("last_"))  # one row per clip
    shot = F.struct("shot_id", F.col("frame").alias("at"), F.lead("shot_id").over(w).alias("next_shot"), F.lead("frame").over(w).alias("next_frame"))
    marks = shots.select("clip_id", "frame", "shot_id").join(F.broadcast(ends), "clip_id").withColumn("shot_", shot).filter("frame <= last_").select("clip_id", "frame", "shot_", F.lit(True).alias("mark_"))
    both = marks.unionByName(rows.withColumn("mark_", F.lit(False)), allowMissingColumns=True)
    order = CLIP().orderBy("frame", F.desc("mark_"), "shot_.shot_id").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("shot_", F.last("shot_", ignorenulls=True).over(order)).filter("not mark_ and shot_ is not null").select(*rows.columns, "shot_.*")


def renumber(shots: DataFrame) -> DataFrame:
    """Contiguous ids by frame per clip (ties: old id)."""
    return shots.select("clip_id", "shot_id", "frame", (F.row_number().over(CLIP().orderBy("frame", "shot_id")) - 1).alias("new_id"))


def shot_stats(shots: DataFrame) -> DataFrame:
    return shots.groupBy("clip_id").agg(F.count("*").alias("shots"), F.count_if("is_serve").alias("serves"), F.count_if("is_volley").alias("volleys"),
                                        F.count_if(F.col("hitter_side") == "near").alias("near_shots"), F.avg("confidence").alias("mean_confidence"))


def same_side_runs(shots: DataFrame, gap: int = 180, long_run: int = 480) -> DataFrame:
    """Runs of impacts from one side, cut at a side change or a gap: a long run keeps its last shot, others their most
    confident (first on ties)."""
    w = CLIP().orderBy("frame", "shot_id")
    cut = F.coalesce(((F.col("hitter_side") != F.lag("hitter_side").over(w)) | (F.col("frame") - F.lag("frame").over(w) > gap)).cast("int"), F.lit(0))
    runs = shots.withColumn("cut", cut).withColumn("run", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = Window.partitionBy("clip_id", "run")
    spans = runs.withColumn("span", F.max("frame").over(r) - F.min("frame").over(r))
    order = r.orderBy(F.when(F.col("span") >= long_run, -F.col("frame")).otherwise(0), F.desc("confidence"), "frame", "shot_id")
    return spans.withColumn("place", F.row_number().over(order)).filter("place = 1").select("clip_id", "shot_id", "frame", "run", "span")


# ---- bounces

def bounce_candidates(ball: DataFrame, window: int = 4, prominence: float = 30.0) -> DataFrame:
    """Local lows of the picture's y (largest y), with a descent before and a rebound after, near a known frame."""
    around = ball.select("clip_id", "frame", "pixel_y", F.count(F.when(KNOWN(), 1)).over(W().rowsBetween(-2, 2)).alias("near_known"), F.max("pixel_y").over(W().rowsBetween(-window, window)).alias("top"),
                         F.min("pixel_y").over(W().rowsBetween(-window, -1)).alias("before"), F.min("pixel_y").over(W().rowsBetween(1, window)).alias("after"))
    fall, rise = F.col("pixel_y") - F.col("before"), F.col("pixel_y") - F.col("after")
    return around.filter((F.col("pixel_y") == F.col("top")) & (fall >= prominence) & (rise >= prominence) & (F.col("near_known") > 0)).select("clip_id", "frame", F.least(fall, rise).alias("score"))


def exclude_near(cands: DataFrame, shots: DataFrame, within: int | str = 10) -> DataFrame:
    """Candidates further than ``within`` frames (a number, or a column of the candidates) from every shot, by the shots before and
    after each in ordered passes per clip."""
    reach = F.col(within) if isinstance(within, str) else F.lit(within)
    ends = cands.groupBy("clip_id").agg(F.max(F.col("frame") + reach).alias("last_"))  # one row per clip
    marks = shots.select("clip_id", "frame").join(F.broadcast(ends), "clip_id").filter("frame <= last_").select("clip_id", "frame", F.lit(True).alias("mark_"))
    both = marks.unionByName(cands.withColumn("mark_", F.lit(False)), allowMissingColumns=True)
    shot = F.when(F.col("mark_"), F.col("frame"))
    near = lambda order: F.last(shot, ignorenulls=True).over(CLIP().orderBy(order, F.desc("mark_")).rowsBetween(Window.unboundedPreceding, 0))
    far = lambda gap: F.coalesce(gap > reach, F.lit(True))
    kept = both.withColumns({"p_": near(F.asc("frame")), "n_": near(F.desc("frame"))}).filter(~F.col("mark_") & far(F.col("frame") - F.col("p_")) & far(F.col("n_") - F.col("frame")))
    return kept.select(*cands.columns)


def ground_contact(cands: DataFrame, ball: DataFrame, half: int = 3) -> DataFrame:
    """Moves a candidate to the largest known y within ``half`` frames; the candidate's own frame wins ties, then the earliest."""
    near = cands.select("clip_id", F.col("frame").alias("detected")).withColumn("frame", F.explode(F.sequence(F.col("detected") - half, F.col("detected") + half)))
    best = F.min(F.struct((-F.col("pixel_y")).alias("y"), (F.col("frame") != F.col("detected")).alias("other"), F.col("frame").alias("frame")))
    return near.join(ball.filter(KNOWN()).select("clip_id", "frame", "pixel_y"), ["clip_id", "frame"]).groupBy("clip_id", "detected").agg(best.alias("b")).select("clip_id", "detected", F.col("b.frame").alias("frame"))


def bounce_rows(bounces: DataFrame, most: float = 8.0) -> DataFrame:
    inside, side = in_court_call(F.col("court_x_ft"), F.col("court_y_ft"))
    far = F.greatest(-F.col("court_x_ft"), F.col("court_x_ft") - 20, -F.col("court_y_ft"), F.col("court_y_ft") - 44)
    return bounces.filter(far <= most).select("clip_id", "bounce_id", inside.alias("is_in"), side.alias("out_side"), zone(F.col("court_y_ft")).alias("zone"), side_of_net(F.col("court_y_ft")).alias("side"))


def between_shots(bounces: DataFrame, shots: DataFrame) -> DataFrame:
    """Previous and next shot of each bounce by strict frame order: shots and bounces in one ordered pass per clip."""
    events = bounces.select("clip_id", "frame", "bounce_id", F.lit(None).cast("long").alias("shot_id")).unionByName(
        shots.select("clip_id", "frame", F.lit(None).cast("long").alias("bounce_id"), F.col("shot_id").cast("long").alias("shot_id")))
    shot = F.when(F.col("shot_id").isNotNull(), F.struct("frame", "shot_id"))
    earlier = lambda order: CLIP().orderBy(order).rangeBetween(Window.unboundedPreceding, -1)  # noqa: E731  a growing frame; the next shot is the last one backwards
    at = events.withColumn("p", F.max(shot).over(earlier(F.asc("frame")))).withColumn("n", F.min(shot).over(earlier(F.desc("frame"))))
    return at.filter("bounce_id is not null").select("clip_id", "bounce_id", "frame", F.col("p.shot_id").alias("prev_shot"), F.col("n.shot_id").alias("next_shot"),
                                                     (F.col("frame") - F.col("p.frame")).alias("frames_since"), (F.col("n.frame") - F.col("frame")).alias("frames_to"))


def cap_per_interval(bounces: DataFrame) -> DataFrame:
    """At most one bounce per (previous, next) interval: highest confidence, earliest on ties."""
    w = Window.partitionBy("clip_id", "prev_shot", "next_shot").orderBy(F.desc("confidence"), "frame", "bounce_id")
    return bounces.withColumn("place", F.row_number().over(w)).filter("place = 1").select("clip_id", "bounce_id", "prev_shot", "next_shot", "confidence")


def bounce_stats(rows: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(F.expr(c))
    return rows.groupBy("clip_id").agg(F.count("*").alias("bounces"), n("is_in").alias("n_in"), n("not is_in").alias("n_out"), *[n(f"zone = '{z}'").alias(z) for z in ("kitchen", "transition", "baseline")],
                                       *[n(f"out_side = '{s}'").alias(f"out_{s}") for s in ("left", "right", "near", "far")])


def volley_flag(shots: DataFrame, linked: DataFrame) -> DataFrame:
    """Volley if no bounce lies in the interval before the shot; serves never are. Confidence says on what that rests."""
    had = linked.filter("next_shot is not null").groupBy("clip_id", F.col("next_shot").alias("shot_id")).agg(F.count("*").alias("n"))
    first = F.row_number().over(CLIP().orderBy("frame", "shot_id")) == 1
    fixed = F.col("is_serve") | first
    return shots.withColumn("fixed", fixed).join(had, ["clip_id", "shot_id"], "left").select("clip_id", "shot_id", (~F.col("fixed") & F.col("n").isNull()).alias("volley"), F.when(F.col("fixed"), 0.9).otherwise(0.4).alias("volley_confidence"))


def classify_stats(shots: DataFrame) -> DataFrame:
    counts = shots.groupBy("clip_id", "shot_type").agg(F.count("*").alias("n"), F.count_if("is_volley").alias("volleys"), F.count_if(F.col("stroke_side") == "forehand").alias("forehands"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(CLIP()))
