"""Scoring against hand-made truth, and data quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .helpers import match_one_to_one
from .tiles import tiled


def score_matches(truth: DataFrame, got: DataFrame, tolerance: int = 12) -> DataFrame:
    """Hits, missed, false, recall and precision per clip of the exclusive match."""
    hits = match_one_to_one(truth.select("clip_id", F.col("frame").cast("long").alias("frame"), F.col("truth_id").cast("long").alias("truth_id")), got, tolerance).groupBy("clip_id").agg(F.count("*").alias("hits"))
    n = truth.groupBy("clip_id").agg(F.count("*").alias("n_truth")).join(got.groupBy("clip_id").agg(F.count("*").alias("n_got")), "clip_id", "full")
    j = n.join(hits, "clip_id", "left").na.fill(0)
    return j.select("clip_id", "hits", (F.col("n_truth") - F.col("hits")).alias("missed"), (F.col("n_got") - F.col("hits")).alias("false"),
                    F.try_divide("hits", "n_truth").alias("recall"), F.try_divide("hits", "n_got").alias("precision"))


def score_types(shots: DataFrame, truth: DataFrame, within: int = 60) -> DataFrame:
    """Confusion of types: each label meets its nearest shot within ``within`` frames (ties: lower id), not exclusively.

    Labels and shots meet by frame bucket, so a label sees the shots of three buckets only."""
    b = lambda c: F.floor(c / within)
    near = truth.select("clip_id", "truth_id", F.col("frame").alias("at"), "true_type").withColumn("bucket", F.explode(F.sequence(b(F.col("at")) - 1, b(F.col("at")) + 1)))
    pairs = near.join(shots.select("clip_id", "shot_id", "frame", "shot_type", b(F.col("frame")).alias("bucket")), ["clip_id", "bucket"]).withColumn("d", F.abs(F.col("frame") - F.col("at"))).filter(F.col("d") <= within)
    best = pairs.groupBy("clip_id", "truth_id", "true_type").agg(F.min(F.struct("d", "shot_id", "shot_type")).alias("m"))
    return best.groupBy("true_type", F.col("m.shot_type").alias("got_type")).agg(F.count("*").alias("n"), F.avg("m.d").alias("mean_distance"))


def score_rally_shots(shots: DataFrame, rallies: DataFrame, slack: int = 60) -> DataFrame:
    """Shots inside each truth window grown by ``slack``, against the truth's count."""
    first, last = F.col("start_frame").cast("long") - slack, F.col("end_frame").cast("long") + slack
    spans = tiled(rallies.select("clip_id", "rally_id", "n_shots", first.alias("first_"), last.alias("last_")), F.col("first_"), F.col("last_"))
    # A window's share in a tile is the shots up to its end less those before its start, in one ordered pass per tile.
    mark = lambda sign, frame: F.struct(F.lit(sign).alias("sign_"), frame.alias("frame"))
    marks = spans.withColumn("m_", F.explode(F.array(mark(-1, F.col("first_")), mark(1, F.col("last_"))))).select("clip_id", "tile_", "rally_id", "n_shots", "m_.*")
    hits = tiled(shots.select("clip_id", F.col("frame").cast("long").alias("frame")), F.col("frame"), F.col("frame")).filter("tile_ is not null").withColumn("sign_", F.lit(0))
    upto = Window.partitionBy("clip_id", "tile_").orderBy("frame", "sign_").rowsBetween(Window.unboundedPreceding, 0)
    counted = marks.unionByName(hits, allowMissingColumns=True).withColumn("upto_", F.count_if(F.col("sign_") == 0).over(upto)).filter("sign_ <> 0")
    got = counted.groupBy("clip_id", "rally_id", F.col("n_shots").alias("truth")).agg(F.sum(F.col("sign_") * F.col("upto_")).alias("got"))
    return got.withColumn("delta", F.col("got") - F.col("truth"))


def alternation_check(shots: DataFrame, roles: DataFrame, court: DataFrame) -> DataFrame:
    """Per clip, over neighbouring shots of a rally (``shots`` has rally_no): pairs of known teams, those of one team (which
    the rules forbid), pairs with an unknown team, returns by the serving team, and the median seconds of both kinds."""
    w = Window.partitionBy("clip_id", "rally_no").orderBy("frame", "shot_id")
    team = F.when(F.col("role").isin("user", "partner"), "near").when(F.col("role").isin("opp_a", "opp_b"), "far")
    rows = (shots.join(roles.select("clip_id", "track_id", "role"), ["clip_id", "track_id"], "left").withColumn("team", team)
            .select("clip_id", "rally_no", "team", F.row_number().over(w).alias("k"), F.lag("team").over(w).alias("before"), (F.col("frame") - F.lag("frame").over(w)).alias("gap")))
    known, same = F.col("team").isNotNull() & F.col("before").isNotNull(), F.col("team") == F.col("before")
    seconds = rows.join(court.select("clip_id", "fps"), "clip_id").withColumn("gap", F.col("gap") / F.col("fps"))
    return seconds.groupBy("clip_id").agg(
        F.count_distinct("rally_no").alias("rallies"), F.count_if(known).alias("pairs"), F.count_if(known & same).alias("same_team"), F.count_if((F.col("k") > 1) & ~known).alias("unknown_pairs"),
        F.count_if((F.col("k") == 2) & known).alias("returns"), F.count_if((F.col("k") == 2) & known & same).alias("own_returns"),
        F.percentile(F.when(known & ~same, F.col("gap")), F.lit(0.5)).alias("legal_gap"), F.percentile(F.when(known & same, F.col("gap")), F.lit(0.5)).alias("same_team_gap"))


def detector_validation(ball: DataFrame, labels: DataFrame) -> DataFrame:
    """Detection rate at 10 and 25 pixels, false positives above 0.5, errors, confidences, per clip."""
    j = labels.join(ball, ["clip_id", "frame"], "left")
    err = F.when(F.col("visible") & F.col("ball_visible"), F.hypot(F.col("pixel_x") - F.col("label_x"), F.col("pixel_y") - F.col("label_y")))
    j = j.withColumn("err", err)
    seen = F.col("ball_visible")
    return j.groupBy("clip_id").agg(
        F.count_if(seen).alias("labelled"), F.avg(F.when(seen, F.coalesce(F.col("err") <= 10, F.lit(False)).cast("int"))).alias("rate_10"), F.avg(F.when(seen, F.coalesce(F.col("err") <= 25, F.lit(False)).cast("int"))).alias("rate_25"),
        F.count_if(~seen & F.coalesce(F.col("visible") & (F.col("confidence") > 0.5), F.lit(False))).alias("false_positives"), F.percentile("err", F.lit(0.5)).alias("median_error"), F.percentile("err", F.lit(0.95)).alias("p95_error"),
        F.avg(F.when(seen, F.col("confidence"))).alias("mean_confidence_seen"))


def venue_gate(signals: DataFrame) -> DataFrame:
    """Refuses clips whose detections are too faint or too rare; ``signals(clip_id, p90_conf, det_rate)``."""
    why = F.when(F.col("p90_conf") < 0.470, "faint").when(F.col("det_rate") < 0.182, "rare").otherwise("ok")
    return signals.withColumn("gate", why)


def venue_signals(ball: DataFrame, least: float = 0.30) -> DataFrame:
    sure = F.coalesce(F.col("visible") & (F.col("confidence") >= least), F.lit(False))
    return ball.groupBy("clip_id").agg(F.avg(sure.cast("int")).alias("det_rate"), F.avg(F.when(sure, F.col("confidence"))).alias("mean_conf"), F.percentile(F.when(sure, F.col("confidence")), F.lit(0.9)).alias("p90_conf"))


def densify_labels(labels: DataFrame, most: int = 4) -> DataFrame:
    """The labels, and linear in-betweens of neighbouring visible ones at most ``most`` frames apart; an unseen label blocks."""
    w = Window.partitionBy("clip_id").orderBy("frame")
    nxt = F.lead(F.struct("frame", "ball_visible", "label_x", "label_y")).over(w)
    pairs = labels.withColumn("n", nxt).filter(F.col("ball_visible") & F.col("n.ball_visible") & (F.col("n.frame") - F.col("frame")).between(2, most))
    t = (F.col("at") - F.col("frame")) / (F.col("n.frame") - F.col("frame"))
    between = pairs.withColumn("at", F.explode(F.sequence(F.col("frame") + 1, F.col("n.frame") - 1))).select(
        "clip_id", F.col("at").alias("frame"), F.lit(True).alias("ball_visible"), (F.col("label_x") + (F.col("n.label_x") - F.col("label_x")) * t).alias("x"),
        (F.col("label_y") + (F.col("n.label_y") - F.col("label_y")) * t).alias("y"), F.lit(True).alias("interpolated"))
    return labels.select("clip_id", "frame", "ball_visible", F.col("label_x").alias("x"), F.col("label_y").alias("y"), F.lit(False).alias("interpolated")).unionByName(between)


def label_speed(labels: DataFrame, within: int = 6) -> DataFrame:
    """Fastest pixels per frame to a neighbouring label within ``within`` frames."""
    w = Window.partitionBy("clip_id").orderBy("frame")
    seen = labels.filter("ball_visible")

    def speed(o):
        gap = F.abs(o["frame"] - F.col("frame"))
        return F.when(gap <= within, F.hypot(o["label_x"] - F.col("label_x"), o["label_y"] - F.col("label_y")) / gap)

    s = F.struct("frame", "label_x", "label_y")
    two = seen.withColumn("p", F.lag(s).over(w)).withColumn("n", F.lead(s).over(w))
    return two.select("clip_id", "frame", F.greatest(speed(F.col("p")), speed(F.col("n"))).alias("speed")).filter("speed is not null")


def detection_confusion(ball: DataFrame, labels: DataFrame, conf: float = 0.5, px: float = 25.0) -> DataFrame:
    j = labels.join(ball, ["clip_id", "frame"])
    said = F.coalesce(F.col("visible") & (F.col("confidence") >= conf), F.lit(False))
    near = F.coalesce(F.hypot(F.col("pixel_x") - F.col("label_x"), F.col("pixel_y") - F.col("label_y")) <= px, F.lit(False))
    seen = F.col("ball_visible")
    return j.groupBy("clip_id").agg(F.count_if(seen & said & near).alias("tp"), F.count_if(seen & ~(said & near)).alias("fn"), F.count_if(~seen & said).alias("fp"), F.count_if(~seen & ~said).alias("tn"))


#: Steps in pixels of a picture 1280 wide between which a ball flies; steps that motion is judged by, and its least share.
FLY_PX, MOST_PX, LEAST_STEPS, LEAST_MOVING = 2.0, 55.0, 20, 0.20


def motion_signals(ball: DataFrame, court: DataFrame, least: float = 0.30) -> DataFrame:
    """Steps of sure detections on neighbouring frames, per clip: how many, their median, the share that moves at all, and the
    share that moves like a ball. Clips without steps have null shares."""
    sure = ball.filter(F.coalesce(F.col("visible") & (F.col("confidence") >= least), F.lit(False))).join(court.select("clip_id", (1280 / F.col("frame_width")).alias("scale")), "clip_id")
    w = Window.partitionBy("clip_id").orderBy("frame")
    step = F.when(F.col("frame") - F.lag("frame").over(w) == 1, F.hypot(F.col("pixel_x") - F.lag("pixel_x").over(w), F.col("pixel_y") - F.lag("pixel_y").over(w)) * F.col("scale"))
    rows = sure.withColumn("step", step)
    return rows.groupBy("clip_id").agg(F.count("step").alias("n_steps"), F.percentile("step", F.lit(0.5)).alias("median_step"), F.avg((F.col("step") >= FLY_PX).cast("int")).alias("moving_share"),
                                       F.avg(F.col("step").between(FLY_PX, MOST_PX).cast("int")).alias("continuity"))


def venue_verdicts(signals: DataFrame, known: DataFrame, most: int = 1000) -> DataFrame:
    """Whether a clip's venue can be analysed, why not, and the known clip it is most like: clip_id, verdict, reason, nearest,
    nearest_recall.

    ``signals(clip_id, p90_conf, det_rate, moving_share, n_steps)``; ``known(clip_id, p90_conf, det_rate, recall)`` are the clips
    that the bars were fitted on, ``most`` at most, since each clip looks at all of them. Missing signals give ``unknown``.
    Motion only counts where it could be measured. Of equally near clips the smallest number is taken."""
    if known.count() > most:
        raise ValueError(f"more than {most} known clips")
    table = known.filter("p90_conf is not null and det_rate is not null").agg(F.collect_list(F.struct("p90_conf", "det_rate", "clip_id", "recall")).alias("known"))
    parked = (F.col("n_steps") >= LEAST_STEPS) & (F.col("moving_share") < LEAST_MOVING)
    missing = F.col("p90_conf").isNull() | F.col("det_rate").isNull()
    reason = F.when(missing, "signals missing").when(F.col("p90_conf") < 0.470, "faint").when(F.col("det_rate") < 0.182, "rare").when(parked, "parked").otherwise("ok")
    near = F.array_min(F.transform("known", lambda k: F.struct((F.abs(k["p90_conf"] - F.col("p90_conf")) + F.abs(k["det_rate"] - F.col("det_rate"))).alias("d"), k["clip_id"].alias("clip_id"), k["recall"].alias("recall"))))
    rows = signals.crossJoin(F.broadcast(table)).withColumns({"reason": reason, "near": F.when(~missing, near)})  # one row of at most ``most`` entries
    verdict = F.when(missing, "unknown").when(F.col("reason") == "ok", "ok").otherwise("not_supported")
    return rows.select("clip_id", verdict.alias("verdict"), "reason", F.col("near.clip_id").alias("nearest"), F.col("near.recall").alias("nearest_recall"))


def sample_labels(labels: DataFrame, n: int = 110, seed: int = 0) -> DataFrame:
    """``n`` visible labels of each clip, those with the smallest hashes of seed, clip and frame: reruns agree."""
    draw = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("clip_id").cast("string"), F.col("frame").cast("string")).cast("binary"))
    seen = labels.filter("ball_visible and label_x is not null and label_y is not null").withColumn("draw", draw)
    return seen.withColumn("place", F.row_number().over(Window.partitionBy("clip_id").orderBy("draw", "frame"))).filter(F.col("place") <= n).drop("draw", "place")
