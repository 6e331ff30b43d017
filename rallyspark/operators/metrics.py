"""Match metrics per clip and role, ratings, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import clamped_linear, lateral, zone

TYPES = ("serve", "drive", "dink", "drop", "lob")


def shot_mix(shots: DataFrame, roles: DataFrame) -> DataFrame:
    """Counts by type per clip (role null) and per clip and role, in one pass by grouping sets."""
    joined = shots.join(roles, ["clip_id", "track_id"])
    return joined.groupingSets([["clip_id"], ["clip_id", "role"]], "clip_id", "role").agg(
        F.count("*").alias("shots"), *[F.count_if(F.col("shot_type") == t).alias(t) for t in TYPES], F.count_if("is_volley").alias("volleys"),
        F.count_if(F.col("stroke_side") == "forehand").alias("forehands"), F.avg(F.col("is_volley").cast("int")).alias("volley_rate"))


def rally_length(rallies: DataFrame) -> DataFrame:
    n = F.col("n_shots")
    buckets = {"len_1": n == 1, "len_2_4": n.between(2, 4), "len_5_8": n.between(5, 8), "len_9_up": n >= 9}
    return rallies.groupBy("clip_id").agg(F.count("*").alias("rallies"), F.avg(n).alias("mean_length"), F.percentile(n, F.lit(0.5)).alias("median_length"), F.max(n).alias("max_length"), *[F.count_if(c).alias(k) for k, c in buckets.items()])


def end_reasons(rallies: DataFrame) -> DataFrame:
    w = Window.partitionBy("clip_id")
    return rallies.groupBy("clip_id", "end_reason").agg(F.count("*").alias("n")).withColumn("share", F.col("n") / F.sum("n").over(w))


def technique(shots: DataFrame, roles: DataFrame) -> DataFrame:
    """Confidence of strokes by side, with the share of confident ones."""
    return shots.join(roles, ["clip_id", "track_id"]).groupBy("clip_id", "role", "stroke_side").agg(F.count("*").alias("n"), F.avg("confidence").alias("mean_confidence"), F.avg((F.col("confidence") >= 0.6).cast("int")).alias("confident_share"))


def third_shots(shots: DataFrame) -> DataFrame:
    """Third shots that are a drop or a drive, of rallies with three shots or more."""
    third = shots.filter("seq = 3").groupBy("clip_id").agg(F.count("*").alias("thirds"), F.count_if(F.col("shot_type") == "drop").alias("drops"), F.count_if(F.col("shot_type") == "drive").alias("drives"))
    return third.withColumn("drop_rate", F.try_divide(F.col("drops"), F.col("drops") + F.col("drives")))


def bounce_in_out(rows: DataFrame) -> DataFrame:
    return rows.groupBy("clip_id").agg(F.count_if("is_in").alias("n_in"), F.count_if(F.expr("not is_in")).alias("n_out"), F.avg(F.col("is_in").cast("int")).alias("in_rate"))


def match_span(shots: DataFrame, bounces: DataFrame, court: DataFrame) -> DataFrame:
    both = shots.select("clip_id", "frame").unionByName(bounces.select("clip_id", "frame")).groupBy("clip_id").agg((F.max("frame") - F.min("frame")).alias("frames"))
    return both.join(court, "clip_id").select("clip_id", (F.col("frames") / F.col("fps")).alias("seconds"))


def error_attribution(rallies: DataFrame, shots: DataFrame, roles: DataFrame) -> DataFrame:
    """Who owns a rally's end: the server, the last hitter, the receiving side, or nobody."""
    last = shots.select("clip_id", F.col("shot_id").alias("last_shot"), "track_id")
    r = rallies.join(last, ["clip_id", "last_shot"], "left").join(roles, ["clip_id", "track_id"], "left")
    owner = (F.when(F.col("end_reason") == "serve_fault", "server").when(F.col("end_reason").isin("ball_out", "net", "kitchen_fault"), "hitter")
             .when(F.col("end_reason") == "double_bounce", "receiver").otherwise("unknown"))
    return r.withColumn("owner", owner).groupBy("clip_id", "owner", F.coalesce("role", F.lit("unattributed")).alias("role")).agg(
        F.count("*").alias("n"), F.avg(F.col("end_confidence") * F.coalesce("role_confidence", F.lit(0.0))).alias("confidence"))


def confidence_envelope(values: DataFrame, value: str, conf: str, n: str) -> DataFrame:
    """{value, confidence, n, limited_by}: mean confidence x n / (n + 8)."""
    c = F.col(conf) * F.col(n) / (F.col(n) + 8)
    return values.select("clip_id", "role", F.struct(F.col(value).alias("value"), c.alias("confidence"), F.col(n).alias("n"), F.when(F.col(n) < 8, "sample_size").otherwise("source").alias("limited_by")).alias("metric"))


def in_rally(frames: DataFrame, rallies: DataFrame) -> DataFrame:
    """Rows inside a rally with the first rally that holds their frame. Rallies are numbered in the order of their starts.

    Rallies are cut where an earlier one is still on; then their starts and the rows stand in one order of frames, and each row
    takes the last start. Nothing is made per frame of a rally."""
    earlier = Window.partitionBy("clip_id").orderBy("rally_id").rowsBetween(Window.unboundedPreceding, -1)
    spans = rallies.select("clip_id", "rally_id", "end_frame", F.greatest(F.col("start_frame"), F.max("end_frame").over(earlier) + 1).alias("from")).filter(F.col("from") <= F.col("end_frame"))
    marks = spans.select("clip_id", F.col("from").alias("at"), F.lit(0).alias("kind"), F.struct("rally_id", "end_frame").alias("rally"))
    rows = frames.select("clip_id", F.col("frame").alias("at"), F.lit(1).alias("kind"), F.struct(*[c for c in frames.columns if c != "clip_id"]).alias("row"))
    last = F.last("rally", ignorenulls=True).over(Window.partitionBy("clip_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    both = marks.unionByName(rows, allowMissingColumns=True).withColumn("rally", last).filter("kind = 1 and at <= rally.end_frame")
    return both.select("clip_id", "row.*", F.col("rally.rally_id").alias("rally_id"))


def role_positions(players: DataFrame, roles: DataFrame) -> DataFrame:
    return players.filter("not transient").join(roles.filter("role <> 'noise'"), ["clip_id", "track_id"]).groupBy("clip_id", "role", "frame").agg((F.round(F.avg("court_x_ft"), 6) + 0.0).alias("x"), (F.round(F.avg("court_y_ft"), 6) + 0.0).alias("y"))  # rounded: a mean on a zone's edge must not depend on the order of its rows


def position_summary(positions: DataFrame) -> DataFrame:
    share = lambda c: F.avg(c.cast("int"))
    z, lat = zone(F.col("y")), lateral(F.col("x"))
    cell = F.when(F.col("x").between(0, 20) & F.col("y").between(0, 22), F.struct(F.floor(F.col("x") / 2), F.floor(F.col("y") / 2)))
    return positions.groupBy("clip_id", "role").agg(F.count("*").alias("frames"), *[share(z == k).alias(k) for k in ("kitchen", "transition", "baseline")], *[share(lat == k).alias(k) for k in ("left", "centre", "right")],
                                                    F.avg("x").alias("mean_x"), F.avg("y").alias("mean_y"), (F.count_distinct(cell) / 110).alias("court_share"))


def movement(positions: DataFrame, rallies: DataFrame, court: DataFrame, seconds: float = 0.2, least: float = 0.3, speed: float = 24.0) -> DataFrame:
    """movement_inside of the positions that lie in a rally."""
    return movement_inside(in_rally(positions, rallies), court, seconds, least, speed)


def movement_inside(rows: DataFrame, court: DataFrame, seconds: float = 0.2, least: float = 0.3, speed: float = 24.0) -> DataFrame:
    """Distance between the mean positions of neighbouring time buckets of one rally, in all, per rally present and per
    minute of frames in rallies; steps below ``least`` feet or faster than ``speed`` feet a second don't count.
    ``rows`` is in_rally of the positions."""
    rows = rows.join(court.select("clip_id", "fps"), "clip_id").withColumn("win", F.greatest(F.lit(1), F.round(seconds * F.col("fps")).cast("int")))
    b = rows.groupBy("clip_id", "role", "rally_id", "fps", "win", F.floor(F.col("frame") / F.col("win")).alias("bucket")).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.count("*").alias("n"))
    w = Window.partitionBy("clip_id", "role").orderBy("bucket", "rally_id")
    next_to = (F.col("bucket") - F.lag("bucket").over(w) == 1) & (F.col("rally_id") == F.lag("rally_id").over(w))
    step = F.when(next_to, F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))
    counts = F.col("step").between(F.lit(least), speed * F.col("win") / F.col("fps"))
    total = b.withColumn("step", step).groupBy("clip_id", "role").agg(
        F.count_if(counts).alias("steps"), F.coalesce(F.sum(F.when(counts, F.col("step"))), F.lit(0.0)).alias("feet"), F.count_distinct("rally_id").alias("rallies"), (F.sum("n") / F.max("fps") / 60).alias("minutes"))
    return total.select("clip_id", "role", "steps", F.round("feet", 4).alias("feet"), "rallies", F.round(F.col("feet") / F.col("rallies"), 4).alias("feet_per_rally"), F.round(F.col("feet") / F.col("minutes"), 4).alias("feet_per_minute"))


def team_positioning(positions: DataFrame) -> DataFrame:
    """Frames with both partners: share with both in the kitchen, and their spacing."""
    a, b = positions.filter("role = 'user'"), positions.filter("role = 'partner'").select("clip_id", "frame", F.col("x").alias("px"), F.col("y").alias("py"))
    gap = F.hypot(F.col("x") - F.col("px"), F.col("y") - F.col("py"))
    return a.join(b, ["clip_id", "frame"]).groupBy("clip_id").agg(F.count("*").alias("frames"), F.avg(((zone(F.col("y")) == "kitchen") & (zone(F.col("py")) == "kitchen")).cast("int")).alias("both_kitchen"),
                                                                  F.avg(gap).alias("mean_gap"), F.percentile(gap, F.lit(0.5)).alias("median_gap"), F.min(gap).alias("min_gap"), F.max(gap).alias("max_gap"))


def heatmap(points: DataFrame, x: str, y: str, by: list[str], size: int = 2) -> DataFrame:
    inside = (F.col(x) >= 0) & (F.col(x) < 20) & (F.col(y) >= 0) & (F.col(y) < 44)
    return points.filter(inside).groupBy(*by, F.floor(F.col(y) / size).alias("row"), F.floor(F.col(x) / size).alias("col")).agg(F.count("*").alias("n"))


def player_block(shots: DataFrame, roles: DataFrame) -> DataFrame:
    return shots.join(roles, ["clip_id", "track_id"]).groupBy("clip_id", "role").agg(F.count("*").alias("shots"), F.count_if("is_serve").alias("serves"), F.count_if(F.col("seq") == 2).alias("returns"), F.avg(F.when(~F.col("is_serve"), F.col("confidence"))).alias("mean_confidence"))


def reconcile(shots: DataFrame, roles: DataFrame) -> DataFrame:
    """Attributed and unattributed shots against all of them."""
    j = shots.join(roles.filter("role <> 'noise'"), ["clip_id", "track_id"], "left")
    return j.groupBy("clip_id").agg(F.count("*").alias("shots"), F.count("role").alias("attributed"), F.count_if(F.col("role").isNull()).alias("unattributed")).withColumn("balanced", F.expr("attributed + unattributed = shots"))


# ---- ratings

#: The weight of each category.
WEIGHTS = {"strategy": 0.20, "third_shot": 0.18, "dink": 0.15, "volley": 0.13, "serve_return": 0.12, "forehand": 0.12, "backhand": 0.10}
#: Knee bends in degrees that are good on a dink and on a drive.
DINK_KNEE, DRIVE_KNEE = (35, 50), (20, 35)


def rating_drivers(shots: DataFrame, roles: DataFrame, positions: DataFrame, moves: DataFrame, rallies: DataFrame) -> DataFrame:
    """One row per clip and role with what the categories are scored by. ``shots`` have seq, front (contact in front of the
    hip) and knee (bend in degrees); ``positions`` is role_positions, ``moves`` is movement."""
    is_ = lambda kind, side=None: (F.col("shot_type") == kind) if side is None else (F.col("shot_type") == kind) & (F.col("stroke_side") == side)
    good = lambda band, test: F.avg(F.when(test & F.col("knee").isNotNull(), F.col("knee").between(*band).cast("int")))
    strokes = [c for side in ("forehand", "backhand") for c in (
        F.count(F.when(F.col("stroke_side") == side, F.col("front"))).alias(f"{side}_n"), F.avg(F.when(F.col("stroke_side") == side, F.col("front"))).alias(f"{side}_front"),
        F.count(F.when(is_("drive", side), F.col("knee"))).alias(f"{side}_knee_n"), good(DRIVE_KNEE, is_("drive", side)).alias(f"{side}_knee"))]
    third = (F.col("seq") == 3) & F.col("shot_type").isin("drop", "drive")
    of_shots = shots.join(roles, ["clip_id", "track_id"]).groupBy("clip_id", "role").agg(
        F.count("*").alias("shots"), F.avg(is_("dink").cast("int")).alias("dink_share"), F.avg(F.col("is_volley").cast("int")).alias("volley_rate"), F.count_if("is_serve").alias("serves"), F.count_if(third).alias("thirds"),
        F.avg(F.when(third, is_("drop").cast("int"))).alias("drop_rate"), F.count(F.when(is_("dink"), F.col("knee"))).alias("dink_knee_n"), good(DINK_KNEE, is_("dink")).alias("dink_knee"), *strokes)
    served = rallies.filter("end_reason = 'serve_fault'").select("clip_id", F.col("first_shot").alias("shot_id")).join(shots.select("clip_id", "shot_id", "track_id"), ["clip_id", "shot_id"]).join(roles, ["clip_id", "track_id"])
    places = position_summary(positions).select("clip_id", "role", "kitchen", "transition")
    return (of_shots.join(places, ["clip_id", "role"], "left").join(moves.select("clip_id", "role", "feet_per_minute"), ["clip_id", "role"], "left").join(team_positioning(positions).select("clip_id", "both_kitchen"), "clip_id", "left")
            .join(rally_length(rallies).select("clip_id", "mean_length"), "clip_id", "left").join(served.groupBy("clip_id", "role").agg(F.count("*").alias("faults")), ["clip_id", "role"], "left").na.fill(0, ["faults"]))


def score_categories(drivers: DataFrame) -> DataFrame:
    """Levels 1..5.5 of the seven categories from rating_drivers; 3.0 where what decides a category is missing or too seldom."""
    def lin(c: str, *line: float) -> Column:
        return F.coalesce(clamped_linear(F.col(c), *line), F.lit(0.0))

    def level(known: Column, value: Column) -> Column:
        return F.round(F.when(F.coalesce(known, F.lit(False)), F.least(F.greatest(value, F.lit(1.0)), F.lit(5.5))).otherwise(3.0), 6)

    def stroke(side: str) -> Column:
        return level(F.col(f"{side}_n") >= 4, lin(f"{side}_front", 0.0, 3.0, 2.5, 4.2) + F.when(F.col(f"{side}_knee_n") >= 3, lin(f"{side}_knee", 0.0, -0.2, 1.0, 0.3)).otherwise(0.0))

    rows = {
        "strategy": level(F.col("kitchen").isNotNull(), lin("kitchen", 0.0, 2.5, 0.6, 4.5) + lin("both_kitchen", 0.0, 0.0, 0.5, 0.4) - lin("transition", 0.2, 0.0, 0.6, 0.6) + lin("feet_per_minute", 40.0, 0.0, 200.0, 0.2)),
        "third_shot": level((F.col("thirds") >= 4) & F.col("drop_rate").isNotNull(), lin("drop_rate", 0.1, 2.8, 0.6, 4.3)),
        "dink": level(F.col("dink_share").isNotNull(), lin("dink_share", 0.0, 2.8, 0.4, 4.3) + lin("mean_length", 3.0, 0.0, 10.0, 0.3) + F.when(F.col("dink_knee_n") >= 3, lin("dink_knee", 0.0, 0.0, 1.0, 0.5)).otherwise(0.0)),
        "volley": level(F.col("volley_rate").isNotNull(), lin("volley_rate", 0.0, 2.8, 0.4, 4.2)),
        "serve_return": level(F.col("serves") > 0, clamped_linear(F.try_divide("faults", "serves"), 0.0, 4.2, 0.3, 2.5)), "forehand": stroke("forehand"), "backhand": stroke("backhand")}
    conf = F.col("shots") / (F.col("shots") + 8)
    return drivers.select("clip_id", "role", F.explode(F.array(*[F.struct(F.lit(k).alias("category"), v.alias("level"), conf.alias("confidence"), F.lit(WEIGHTS[k]).alias("weight")) for k, v in rows.items()])).alias("c")).select("clip_id", "role", "c.*")


def half_step(x: Column) -> Column:
    """Nearest half, halves to even."""
    return F.bround(x * 2) / 2


def overall_rating(scores: DataFrame) -> DataFrame:
    wc = F.col("weight") * F.col("confidence")
    r = scores.groupBy("clip_id", "role").agg(F.coalesce(F.try_divide(F.sum(F.col("level") * wc), F.sum(wc)), F.sum(F.col("level") * F.col("weight")) / F.sum("weight")).alias("rating"), F.sum(wc).alias("confidence"))
    half = 0.25 + 1.25 * (1 - F.col("confidence"))
    return r.select("clip_id", "role", "rating", "confidence", half_step(F.col("rating")).alias("band"), (F.col("rating") - half).alias("low"), (F.col("rating") + half).alias("high"), F.least(F.lit(5.0), half_step(F.col("rating")) + 0.5).alias("next_target"))


def focus_areas(scores: DataFrame, target: float = 4.5, top: int = 6) -> DataFrame:
    gap = (target - F.col("level")) * F.col("weight") * (0.5 + 0.5 * F.col("confidence"))
    w = Window.partitionBy("clip_id", "role").orderBy(F.desc("priority"), "category")
    return scores.filter(F.col("level") < target).withColumn("priority", F.round(gap, 6)).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top).select("clip_id", "role", "category", "priority", "rank")
