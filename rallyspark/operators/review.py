"""Gates on events, identity of tracks, ratings in words, and checks of labels and events against truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import bbox_distance
from .ball import KNOWN, W, grounded_fraction, max_jump
from .shots import CLIP
from .tiles import TILE, in_spans, tiled


# ---- gates

def contamination_gates(shots: DataFrame, ball: DataFrame, jump: float = 40.0, least_run: int = 8, latch: float = 60.0, half: int = 30) -> DataFrame:
    """Why a shot on the ball's series is rejected: a far jump into a short known run, or a far step within ``half`` frames."""
    known = ball.filter(KNOWN()).withColumn("p", F.lag(F.struct("frame", "pixel_x", "pixel_y")).over(W()))
    starts = F.coalesce(F.col("frame") - F.col("p.frame") > 1, F.lit(True))
    far = F.hypot(F.col("pixel_x") - F.col("p.pixel_x"), F.col("pixel_y") - F.col("p.pixel_y")) / (F.col("frame") - F.col("p.frame"))
    runs = known.withColumn("jump", F.when(starts, F.coalesce(far, F.lit(0.0)))).withColumn("run", F.sum(starts.cast("int")).over(W().rowsBetween(Window.unboundedPreceding, 0)))
    r = Window.partitionBy("clip_id", "run")
    at = runs.select("clip_id", "frame", F.max("jump").over(r).alias("jump"), F.count("*").over(r).alias("run_length"))
    rows = shots.select("clip_id", "shot_id", "frame").join(at, ["clip_id", "frame"]).join(max_jump(shots, ball, half), ["clip_id", "frame"], "left")
    reason = F.when((F.col("jump") > jump) & (F.col("run_length") < least_run), "blip").when(F.col("max_jump") >= latch, "latch").otherwise("kept")
    return rows.select("clip_id", "shot_id", "run_length", reason.alias("reason"))


def drop_ground_balls(shots: DataFrame, ball: DataFrame, court: DataFrame, most: float = 0.70) -> DataFrame:
    """Shots where the ball's ground point stays on the court go; an unknown share stays."""
    rows = shots.select("clip_id", "shot_id", "frame").join(grounded_fraction(ball, court), ["clip_id", "frame"], "left")
    return rows.filter(F.coalesce(F.col("grounded") < most, F.lit(True))).select("clip_id", "shot_id", "grounded")


def at_feet_and_flip(cands: DataFrame, ball: DataFrame, players: DataFrame, k: int = 3, least: float = 30.0, most: float = 400.0) -> DataFrame:
    """Whether a bounce candidate lies within half a box height of the nearest box, and whether the ball turns from falling to rising over k frames."""
    y = F.col("pixel_y")
    series = ball.select("clip_id", "frame", "pixel_x", "pixel_y", (y - F.lag(y, k).over(W())).alias("fall"), (F.lead(y, k).over(W()) - y).alias("rise"))
    d = bbox_distance(F.col("pixel_x"), y, *[F.col(f"bbox_{c}") for c in ("x1", "y1", "x2", "y2")])
    radius = F.least(F.greatest(0.5 * (F.col("bbox_y2") - F.col("bbox_y1")), F.lit(least)), F.lit(most))
    rows = cands.join(series, ["clip_id", "frame"]).join(players.filter("not transient"), ["clip_id", "frame"], "left")
    near = rows.groupBy("clip_id", "frame", "fall", "rise").agg(F.min(F.when(d.isNotNull(), F.struct(d.alias("d"), radius.alias("r")))).alias("n"))
    return near.select("clip_id", "frame", F.coalesce(F.col("n.d") <= F.col("n.r"), F.lit(False)).alias("at_feet"), F.coalesce((F.col("fall") > 0) & (F.col("rise") < 0), F.lit(False)).alias("flip"))


def serve_appearances(ball: DataFrame, gap: int = 3, speed: float = 5.0, least_run: int = 4) -> DataFrame:
    """Starts of known runs after a long unknown stretch, with launch speed and enough length; a clip's first run counts."""
    known = ball.filter(KNOWN()).withColumn("before", F.lag("frame").over(W())).withColumn("n_", F.lead(F.struct("frame", "pixel_x", "pixel_y")).over(W()))
    starts = F.coalesce(F.col("frame") - F.col("before") > 1, F.lit(True))
    runs = known.withColumn("starts", starts).withColumn("run", F.sum(starts.cast("int")).over(W().rowsBetween(Window.unboundedPreceding, 0)))
    launch = F.hypot(F.col("n_.pixel_x") - F.col("pixel_x"), F.col("n_.pixel_y") - F.col("pixel_y")) / (F.col("n_.frame") - F.col("frame"))
    rows = runs.withColumn("run_length", F.count("*").over(Window.partitionBy("clip_id", "run"))).withColumn("launch", launch)
    return rows.filter(F.col("starts") & F.coalesce(F.col("frame") - F.col("before") - 1 >= gap, F.lit(True)) & (F.col("launch") >= speed) & (F.col("run_length") >= least_run)).select("clip_id", "frame", "launch", "run_length")


# ---- identity

def resolve_clicks(clicks: DataFrame, players: DataFrame, most: float = 150.0) -> DataFrame:
    """The nearest box on each click's frame (ties: smaller track), with an error if there is none or it is far."""
    d = bbox_distance(F.col("click_x"), F.col("click_y"), *[F.col(f"bbox_{c}") for c in ("x1", "y1", "x2", "y2")])
    best = clicks.join(players.select("clip_id", "frame", "track_id", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2"), ["clip_id", "frame"], "left").groupBy("clip_id", "click_id").agg(F.min(F.when(d.isNotNull(), F.struct(d.alias("d"), "track_id"))).alias("b"))
    error = F.when(F.col("b.d").isNull(), "no box").when(F.col("b.d") > most, "too far")
    return best.select("clip_id", "click_id", F.when(error.isNull(), F.col("b.track_id")).alias("track_id"), F.round("b.d", 4).alias("distance"), error.alias("error"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def track_similarity(tracks: DataFrame, most_gap: int = 240, most_ft: float = 12.0, height_ft: float = 0.9) -> DataFrame:
    """Every track against its clip's anchor, the longest track (ties: smaller id): signature, height and continuity, weighted.

    ``tracks`` has one row per track with signature, height, first and last frame and place; a clip has few tracks.
    """
    anchor = tracks.groupBy("clip_id").agg(F.max_by(F.struct("track_id", "signature", "height", "last_frame", "last_x", "last_y"), F.struct("n_rows", -F.col("track_id"))).alias("a"))
    rows = tracks.join(anchor, "clip_id").filter("track_id <> a.track_id")
    look, tall = cosine(F.col("signature"), F.col("a.signature")), F.greatest(F.lit(0.0), 1 - F.abs(F.col("height") - F.col("a.height")) / height_ft)
    gap, far = F.col("first_frame") - F.col("a.last_frame"), F.hypot(F.col("first_x") - F.col("a.last_x"), F.col("first_y") - F.col("a.last_y"))
    follows = F.when(gap.between(0, most_gap) & (far <= most_ft), (1 - gap / most_gap) * (1 - far / most_ft)).otherwise(0.0)
    score = F.when(look.isNull(), 0.6 * tall + 0.4 * follows).otherwise(0.60 * look + 0.25 * tall + 0.15 * follows)
    return rows.select("clip_id", "track_id", F.col("a.track_id").alias("anchor_id"), F.round(score, 5).alias("score"))


def rally_shots(shots: DataFrame, rallies: DataFrame) -> DataFrame:
    """Shots of a listed rally; all shots of clips that list none."""
    listed = rallies.select("clip_id", F.col("rally_id").alias("rally_no"), F.lit(True).alias("listed"))
    clips = rallies.select("clip_id").distinct().withColumn("has", F.lit(True))
    return shots.join(listed, ["clip_id", "rally_no"], "left").join(clips, "clip_id", "left").filter("listed or has is null").select("clip_id", "shot_id", "rally_no")


def role_maps(roles: DataFrame, least: float = 0.55) -> DataFrame:
    """Confidence of each role as the mean of its tracks; below ``least`` it counts as contaminated."""
    mean = F.round(F.avg("role_confidence"), 6)
    return roles.filter("role <> 'noise'").groupBy("clip_id", "role").agg(F.count("*").alias("tracks"), mean.alias("confidence"), (mean < least).alias("contaminated"))


# ---- ratings in words

def category_confidence(scores: DataFrame, clips: DataFrame, synthetic_factor: float = 0.35, read_cap: float = 0.30, count_cap: float = 0.05) -> DataFrame:
    """Confidence, its limiter (first on ties) and the coverage of each category; on synthetic clips only strategy keeps its confidence."""
    stroke = F.col("category").isin("forehand", "backhand")  # at most one quality is read; a level of 3 says that none was
    cap = F.when(stroke & (F.col("level") == 3.0), count_cap).when(stroke, read_cap).otherwise(1.0)
    own = F.when(F.col("synthetic") & (F.col("category") != "strategy"), F.col("confidence") * synthetic_factor).otherwise(F.col("confidence"))
    least = F.array_min(F.array(F.struct(own.alias("c"), F.lit(0).alias("at"), F.when(F.col("synthetic") & (F.col("category") != "strategy"), "synthetic ball").otherwise("sample size").alias("why")), F.struct(cap.alias("c"), F.lit(1).alias("at"), F.lit("stroke reads").alias("why"))))
    rows = scores.join(clips, "clip_id").withColumn("l", least)
    status = F.when(F.col("l.c") >= 0.5, "real").when(F.col("l.c") >= 0.1, "partial").otherwise("uncovered")
    return rows.select("clip_id", "role", "category", "level", "weight", F.col("l.c").alias("confidence"), F.col("l.why").alias("limiter"), status.alias("coverage"), "synthetic")


def coverage_summary(rated: DataFrame) -> DataFrame:
    """Weight by coverage and the categories that are covered, in the order of their names."""
    names = lambda s: F.array_join(F.array_sort(F.collect_set(F.when(F.col("coverage") == s, F.col("category")))), ",")
    weight = lambda c: F.round(F.sum(F.when(c, F.col("weight")).otherwise(0.0)), 6)
    return rated.groupBy("clip_id", "role").agg(weight(F.col("coverage") == "real").alias("real_weight"), weight(F.col("synthetic")).alias("synthetic_weight"), names("real").alias("real_categories"), names("partial").alias("partial_categories"))


#: A drill table made up here: category, drill, and the level up to which it helps.
DRILLS = [("third_shot", "drop_feed", 2.5), ("third_shot", "drop_target", 3.5), ("third_shot", "drop_drive_choice", 4.5), ("dink", "cross_dink", 2.5), ("dink", "dink_ladder", 3.5), ("dink", "dink_speed_up", 4.5),
          ("volley", "block_volley", 2.5), ("volley", "hands_battle", 3.5), ("volley", "counter", 4.5), ("serve_return", "deep_serve", 2.5), ("serve_return", "serve_depth", 3.5), ("serve_return", "serve_spots", 4.5)]


def drills(rated: DataFrame, top: int = 2) -> DataFrame:
    """The next ``top`` drills of each category below its top level, with a finding in words."""
    table = rated.sparkSession.createDataFrame(DRILLS, "category string, drill string, upto double")
    rows = rated.withColumn("level", F.round("level", 6)).join(F.broadcast(table), "category").filter("level < upto")
    w = Window.partitionBy("clip_id", "role", "category").orderBy("upto")
    verdict = F.when(F.col("level") < 2.5, "weak").when(F.col("level") < 3.5, "developing").otherwise("sound")
    return (rows.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= top)
            .select("clip_id", "role", "category", F.col("place").cast("long").alias("place"), "drill", F.concat_ws(" ", F.col("category"), F.lit("is"), verdict).alias("finding")))


def operator_notes(rated: DataFrame, least: float = 0.6) -> DataFrame:
    """What limits the categories that are read from real clips but are not sure, and which these are."""
    return rated.filter(~F.col("synthetic") & (F.col("confidence") < least)).groupBy("clip_id", "limiter").agg(F.array_join(F.array_sort(F.collect_set("category")), ",").alias("affected"), F.count("*").alias("n"))


def next_target(bands: DataFrame, cap: float = 5.0) -> DataFrame:
    """The next half step above a band, at most ``cap``."""
    return bands.select("clip_id", "role", F.least(F.floor(F.col("rating") * 2) / 2 + 0.5, F.lit(cap)).alias("target"))


# ---- against truth

def recall_census(truth: DataFrame, ball: DataFrame, shots: DataFrame, half: int = 60, least: int = 6) -> DataFrame:
    """Per known event whether a shot is near, else whether the ball was seen (the rules missed it) or not (the detector
    did). ``half`` is one second of frames; events meet frames by clip and second."""
    bucket = F.floor(F.col("frame") / half)
    near = truth.select("clip_id", "truth_id", F.col("frame").alias("at"), F.explode(F.sequence(bucket - 1, bucket + 1)).alias("bucket"))

    def within(other: DataFrame) -> DataFrame:
        return near.join(other.withColumn("bucket", bucket), ["clip_id", "bucket"]).filter(F.abs(F.col("frame") - F.col("at")) <= half).groupBy("clip_id", "truth_id")

    seen = within(ball.filter("visible").select("clip_id", "frame", "confidence")).agg(F.count("*").alias("visible_frames"), F.max("confidence").alias("best"))
    hit = within(shots.select("clip_id", "frame", "is_serve")).agg(F.bool_or("is_serve").alias("serve"))
    rows = truth.select("clip_id", "truth_id").join(seen, ["clip_id", "truth_id"], "left").join(hit, ["clip_id", "truth_id"], "left")
    n = F.coalesce("visible_frames", F.lit(0))
    return rows.select("clip_id", "truth_id", n.alias("visible_frames"), "best", F.when(F.col("serve").isNotNull(), "ok").when(n >= least, "algorithm").otherwise("detector").alias("cause"))


def label_audit(ball: DataFrame, labels: DataFrame, width: float = 0.5, close: float = 6.0, bad: float = 20.0) -> DataFrame:
    """Distance of detections to labels in processing pixels (``width`` of the source's): median, share close, share surely wrong."""
    d = F.hypot(F.col("pixel_x") - F.col("label_x"), F.col("pixel_y") - F.col("label_y")) * width
    rows = labels.filter("ball_visible").join(ball.filter("visible"), ["clip_id", "frame"]).withColumn("d", d)
    return rows.groupBy("clip_id").agg(F.count("*").alias("n"), F.percentile("d", F.lit(0.5)).alias("median_px"), F.avg((F.col("d") <= close).cast("int")).alias("close_share"),
                                       F.avg(((F.col("d") > bad) & (F.col("confidence") >= 0.5)).cast("int")).alias("bad_share"))


def venue_table(signals: DataFrame, venues: int = 4) -> DataFrame:
    """Means of the clips of each venue, for clips numbered round the venues."""
    return signals.groupBy((F.col("clip_id") % venues).alias("venue")).agg(F.count("*").alias("clips"), *[F.avg(c).alias(c) for c in ("det_rate", "mean_conf", "p90_conf")])


def rank_agreement(signals: DataFrame) -> DataFrame:
    """Spearman's correlation of the detection rate with the ninth decile of confidence over all clips (mean ranks on ties).

    Ranks come from counts per distinct value, so the ordered window runs over one row per value of a clip-level table.
    """
    def ranked(c: str) -> DataFrame:
        counts = signals.groupBy(F.col(c).alias("v")).agg(F.count("*").alias("n"))
        below = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("v")) - F.col("n")
        return counts.select(F.col("v").alias(c), (below + (F.col("n") + 1) / 2).alias(f"{c}_rank"))

    return signals.join(ranked("det_rate"), "det_rate").join(ranked("p90_conf"), "p90_conf").agg(F.count("*").alias("clips"), F.round(F.corr("det_rate_rank", "p90_conf_rank"), 9).alias("spearman"))


def remap_labels(labels: DataFrame, drift: DataFrame) -> DataFrame:
    """Labels moved by the drift of the nearest frame that was measured (ties: the lower); on a collision the first label stays."""
    events = labels.select("clip_id", "frame", "ball_visible", "label_x", "label_y", F.lit(None).cast("long").alias("shift")).unionByName(
        drift.select("clip_id", "frame", F.lit(None).cast("boolean").alias("ball_visible"), F.lit(None).cast("double").alias("label_x"), F.lit(None).cast("double").alias("label_y"), F.col("shift").cast("long").alias("shift")))
    here = F.when(F.col("shift").isNotNull(), F.struct("frame", "shift"))
    upto = lambda order, last: CLIP().orderBy(order).rangeBetween(Window.unboundedPreceding, last)  # noqa: E731  frames that only grow, forwards and backwards
    rows = events.withColumn("a", F.max(here).over(upto(F.asc("frame"), 0))).withColumn("b", F.min(here).over(upto(F.desc("frame"), -1))).filter("shift is null")
    nearer = F.col("b").isNotNull() & (F.col("a").isNull() | (F.col("b.frame") - F.col("frame") < F.col("frame") - F.col("a.frame")))
    moved = rows.withColumn("old_frame", F.col("frame")).withColumn("frame", F.col("frame") + F.coalesce(F.when(nearer, F.col("b.shift")).otherwise(F.col("a.shift")), F.lit(0)))
    first = F.row_number().over(Window.partitionBy("clip_id", "frame").orderBy("old_frame"))
    return moved.withColumn("place", first).filter("place = 1").select("clip_id", "frame", "old_frame", "ball_visible", "label_x", "label_y")


def training_manifest(labels: DataFrame, scale: float = 0.25, hold_out: int = 0) -> DataFrame:
    """Labels whose window of three frames is in range, with coordinates rescaled and the split: one clip is held out."""
    fits = F.col("frame") >= 1
    inside = F.coalesce((F.col("label_x") * scale).between(0, 1920 * scale) & (F.col("label_y") * scale).between(0, 1080 * scale), ~F.col("ball_visible"))
    return labels.filter(fits).select("clip_id", (F.col("frame") - 1).alias("first_frame"), (F.col("frame") + 1).alias("last_frame"), (F.col("label_x") * scale).alias("x"), (F.col("label_y") * scale).alias("y"),
                                      inside.alias("in_bounds"), F.when(F.col("clip_id") == hold_out, "holdout").otherwise("train").alias("split"))


def in_play_bound(bounces: DataFrame, rallies: DataFrame) -> DataFrame:
    """Bounces inside the rallies' spans against their shots, which bound them, and bounces outside."""
    sides = in_spans(bounces.select("clip_id", "frame"), rallies).groupBy("clip_id").agg(F.count_if("in_").alias("inside"), F.count_if(~F.col("in_")).alias("outside"))
    most = rallies.groupBy("clip_id").agg(F.sum("n_shots").alias("shots"))
    return sides.join(most, "clip_id").withColumn("within_bound", F.col("inside") <= F.col("shots"))


def impact_report(shots: DataFrame, truth: DataFrame, within: int = 6) -> DataFrame:
    """Recall of true serves and others, and precision of serves, where one shot may answer several true events."""
    kind = lambda serve: F.when(serve, "serve").otherwise("other").alias("kind")
    side = lambda df, serve, true: df.select("clip_id", F.col("frame").cast("long").alias("frame"), kind(serve), F.lit(true).alias("true_"))
    both = side(truth, F.col("true_type") == "serve", True).unionByName(side(shots, F.col("is_serve"), False))
    # Events near a tile's end are in both tiles; each is judged in its own.
    w = Window.partitionBy("clip_id", "tile_").orderBy("frame").rangeBetween(-within, within)
    seen = lambda true: F.max(F.when(F.col("true_") == true, True)).over(w)
    rows = tiled(both, F.col("frame") - within, F.col("frame") + within).withColumn("hit", F.when(F.col("true_"), seen(False)).otherwise(seen(True)) & F.col("frame").isNotNull())
    own = rows.filter(F.col("tile_").eqNullSafe(F.floor(F.col("frame") / TILE)))
    n = lambda c: F.count_if(F.expr(c))
    sums = own.groupBy("clip_id", "kind").agg(n("true_").alias("n_true"), n("true_ and hit").alias("found"), n("not true_").alias("n_got"), n("not true_ and hit").alias("right"))
    return sums.filter("n_true > 0 and n_got > 0").withColumn("recall", F.col("found") / F.col("n_true")).withColumn("precision", F.col("right") / F.col("n_got"))
