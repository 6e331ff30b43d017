"""Player tracks: smoothing, life, roles over frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import in_rect, project

TRACK = ["clip_id", "track_id"]


def smooth_and_project(players: DataFrame, court: DataFrame, half: int = 4, reliable: float = 6.0) -> DataFrame:
    """Centred rolling median of the foot point per track, projected again."""
    w = Window.partitionBy(*TRACK).orderBy("frame").rowsBetween(-half, half)
    smooth = players.select("clip_id", "track_id", "frame", F.percentile("foot_x", F.lit(0.5)).over(w).alias("foot_x"), F.percentile("foot_y", F.lit(0.5)).over(w).alias("foot_y"))
    x, y = project(F.col("foot_x"), F.col("foot_y"))
    return smooth.join(court, "clip_id").select("clip_id", "track_id", "frame", "foot_x", "foot_y", x.alias("court_x_ft"), y.alias("court_y_ft"),
                                                in_rect(x, y).alias("in_court"), in_rect(x, y, reliable, reliable).alias("court_pos_reliable"))


def flag_transient(players: DataFrame, least: int = 30) -> DataFrame:
    """Tracks that live under ``least`` frames or never enter the tracking zone (the court and 15 ft around)."""
    return players.groupBy(*TRACK).agg((F.max("frame") - F.min("frame") + 1).alias("life"), F.bool_or(in_rect(F.col("court_x_ft"), F.col("court_y_ft"), 5, 15)).alias("in_zone")).withColumn(
        "transient", (F.col("life") < least) | ~F.col("in_zone"))


def crowd_warning(players: DataFrame, court: DataFrame, seconds: float = 5.0, share: float = 0.8, most: int = 4) -> DataFrame:
    """Clips with more than ``most`` tracks that live longer than ``seconds`` and are mostly in court."""
    tracks = players.groupBy(*TRACK).agg((F.max("frame") - F.min("frame") + 1).alias("life"), F.avg(F.col("in_court").cast("int")).alias("inside")).join(court.select("clip_id", "fps"), "clip_id")
    return tracks.filter((F.col("life") > seconds * F.col("fps")) & (F.col("inside") >= share)).groupBy("clip_id").agg(F.count("*").alias("tracks"), F.array_sort(F.collect_list("track_id")).alias("track_ids")).filter(F.col("tracks") > most)


def track_summary(players: DataFrame) -> DataFrame:
    share = lambda c: F.avg(c.cast("int"))
    return players.groupBy(*TRACK).agg(
        F.count("*").alias("rows"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.min_by("court_x_ft", "frame").alias("first_x"), F.max_by("court_x_ft", "frame").alias("last_x"),
        F.percentile("court_x_ft", F.lit(0.5)).alias("median_x"), F.percentile("court_y_ft", F.lit(0.5)).alias("median_y"),
        F.percentile(F.col("bbox_y2") - F.col("bbox_y1"), F.lit(0.75)).alias("height_px"), share(F.col("in_court")).alias("in_court_share"),
        share(in_rect(F.col("court_x_ft"), F.col("court_y_ft"), 5, 15)).alias("in_envelope_share"), share(F.col("is_user")).alias("user_share"))


def noise_tracks(summary: DataFrame, life: int = 60, least: float = 0.15) -> DataFrame:
    """Tracks to leave out: short, centred outside the play envelope, or seldom in it."""
    short = F.col("last_frame") - F.col("first_frame") + 1 < life
    outside = ~in_rect(F.col("median_x"), F.col("median_y"), 5, 15)
    return summary.filter(short | outside | (F.col("in_envelope_share") < least)).select(*TRACK, F.when(short, "short").when(outside, "outside").otherwise("seldom").alias("reason"))


def user_segments(players: DataFrame, absent: int = 30) -> DataFrame:
    """Segments of the user: rows marked as user, cut where no such row comes for more than ``absent`` frames."""
    user = players.filter("is_user").select("clip_id", "frame").distinct()
    w = Window.partitionBy("clip_id").orderBy("frame")
    cut = user.withColumn("cut", F.coalesce((F.col("frame") - F.lag("frame").over(w) > absent).cast("int"), F.lit(0)))
    seg = cut.withColumn("segment", F.sum("cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = seg.groupBy("clip_id", "segment").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("frames"))
    return out.withColumn("gap_after", F.lead("start_frame").over(Window.partitionBy("clip_id").orderBy("segment")) - F.col("end_frame") - 1)


def track_overlap(players: DataFrame) -> DataFrame:
    """For each pair of tracks of a clip, the share of the first one's frames that the second one shares."""
    p = players.filter("not transient").select("clip_id", "frame", "track_id").distinct()
    pairs = p.join(p.withColumnRenamed("track_id", "other"), ["clip_id", "frame"]).filter("track_id <> other")
    n = p.groupBy(*TRACK).agg(F.count("*").alias("n"))
    return pairs.groupBy("clip_id", "track_id", "other").agg(F.count("*").alias("shared")).join(n, TRACK).select("clip_id", "track_id", "other", "shared", (F.col("shared") / F.col("n")).alias("share"))


def role_summary(players: DataFrame, roles: DataFrame) -> DataFrame:
    return players.join(roles, TRACK).groupBy("clip_id", "role").agg(
        F.count_distinct("track_id").alias("tracks"), F.count_distinct("frame").alias("frames"), F.count("*").alias("rows"), F.avg(F.col("is_user").cast("int")).alias("user_rows"))


def role_consistency(players: DataFrame, roles: DataFrame) -> DataFrame:
    """Per clip and role: frames present, and frames on which two tracks hold the role."""
    per = players.join(roles, TRACK).filter("role <> 'noise'").groupBy("clip_id", "role", "frame").agg(F.count_distinct("track_id").alias("held"))
    return per.groupBy("clip_id", "role").agg(F.count("*").alias("present"), F.count_if(F.col("held") > 1).alias("duplicate"))


def role_timeline(players: DataFrame, roles: DataFrame, top: int = 2) -> DataFrame:
    spans = players.join(roles, TRACK).groupBy("clip_id", "role", "track_id").agg(F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count("*").alias("rows"))
    return spans.withColumn("place", F.row_number().over(Window.partitionBy("clip_id", "role").orderBy(F.desc("rows"), "track_id"))).filter(F.col("place") <= top)


def sample_per_track(players: DataFrame, n: int = 5) -> DataFrame:
    """``n`` evenly spaced rows per track (first and last included)."""
    w = Window.partitionBy(*TRACK)
    numbered = players.select(*TRACK, "frame", (F.row_number().over(w.orderBy("frame")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    picks = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor(k * (F.col("n") - 1) / (n - 1))))
    return numbered.filter(F.array_contains(picks, F.col("i").cast("long"))).select(*TRACK, "frame")


def seed_user(players: DataFrame, window: int = 60) -> DataFrame:
    """The near-side track with the largest median x in the opening frames, how far it is ahead and a confidence."""
    early = players.filter((F.col("frame") < window) & (F.col("court_y_ft") < 22)).groupBy(*TRACK).agg(F.percentile("court_x_ft", F.lit(0.5)).alias("median_x"))
    w = Window.partitionBy("clip_id").orderBy(F.desc("median_x"), "track_id")
    ranked = early.withColumn("place", F.row_number().over(w)).withColumn("ahead", F.col("median_x") - F.lead("median_x").over(w))
    conf = F.when(F.col("ahead") < 2, 0.5).otherwise(F.least(F.lit(0.9), 0.5 + F.coalesce("ahead", F.lit(8.0)) / 20))
    return ranked.filter("place = 1").select(*TRACK, "median_x", "ahead", conf.alias("confidence"))
