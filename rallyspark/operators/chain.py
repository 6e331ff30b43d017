"""From ball and players to shots: candidates, gates, players, handling runs, serves, repeats, ground balls, points.

Every step is a join or window by clip; thresholds are columns of scaled_params. The steps after the players run only on
clips whose ball is real (``real``). Greedy rules run in the chains of helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import NET, bbox_distance, in_rect, project, side_of_net, speed_change, turn_degrees
from ..sources.readers import written
from .ball import W, drop_teleports
from .helpers import accept_serves, dedup_serves, same_track_repeats, suppress_neighbours
from .params import scaled_params

#: Frames of a bucket in which events meet the frames around them.
BUCKET = 60
#: Feet beyond the net, and frames in a row, that prove that a reconstructed ball went over.
CROSS_FT, CROSS_FRAMES = 5.0, 10


def series(ball: DataFrame, params: DataFrame) -> DataFrame:
    """One row per frame: place, known, neighbours, turn and speed change, and the known run it lies in, after teleports went."""
    kept = drop_teleports(ball.join(params, "clip_id"), F.col("max_ball_speed"))
    known = F.expr("visible or interpolated") & ~F.col("dropped")
    b = kept.select(*params.columns, "frame", "visible", "dropped", known.alias("known"), F.when(known, F.col("pixel_x")).alias("x"), F.when(known, F.col("pixel_y")).alias("y"))
    here = F.when(F.col("known"), F.struct("frame", "x", "y"))
    back = Window.partitionBy("clip_id").orderBy(F.desc("frame"))  # backwards, so that frames of windows only grow
    b = b.withColumn("p", F.last(here, ignorenulls=True).over(W().rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "starts", F.col("known") & ~F.coalesce(F.lag("known").over(W()), F.lit(False))).withColumn(
        "n", F.last(here, ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))).withColumn(
        "run_end", F.coalesce(F.last(F.when(~F.col("known"), F.col("frame")), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, 0)) - 1, F.max("frame").over(Window.partitionBy("clip_id"))))
    ax, ay, bx, by = F.col("x") - F.lag("x").over(W()), F.col("y") - F.lag("y").over(W()), F.lead("x").over(W()) - F.col("x"), F.lead("y").over(W()) - F.col("y")
    step = F.hypot(F.col("x") - F.col("p.x"), F.col("y") - F.col("p.y")) / (F.col("frame") - F.col("p.frame"))
    v = b.withColumns({"ax": ax, "ay": ay, "bx": bx, "by": by, "step": step})
    near = lambda s, far: F.when(F.abs(F.col(f"{s}.frame") - F.col("frame")) <= F.col(far), F.col(s))
    upto = W().rowsBetween(Window.unboundedPreceding, 0)
    return v.withColumns({
        "fast": F.greatest(F.hypot("ax", "ay"), F.hypot("bx", "by")), "turn": turn_degrees(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")), "ratio": speed_change(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")),
        "jump": F.last(F.when(F.col("starts"), F.coalesce("step", F.lit(0.0))), ignorenulls=True).over(upto), "run_start": F.last(F.when(F.col("starts"), F.col("frame")), ignorenulls=True).over(upto),
        "before": near("p", "velocity_window"), "after": near("n", "velocity_window")}).withColumn("run_length", F.col("run_end") - F.col("run_start") + 1)


def around(events: DataFrame, frames: DataFrame, half: str) -> DataFrame:
    """Events joined with the rows of ``frames`` that lie within ``half`` (a column) frames, by clip and bucket."""
    at = events.select("clip_id", F.col("frame").alias("at"), half).withColumn("bucket", F.explode(F.sequence(F.floor((F.col("at") - F.col(half)) / BUCKET), F.floor((F.col("at") + F.col(half)) / BUCKET))))
    return at.join(frames.withColumn("bucket", F.floor(F.col("frame") / BUCKET)), ["clip_id", "bucket"]).filter(F.abs(F.col("frame") - F.col("at")) <= F.col(half))


def nearest_player(events: DataFrame, players: DataFrame, wrists: DataFrame | None = None) -> DataFrame:
    """``events(clip_id, frame, x, y, assoc_*)`` with the nearest player in reach: a visible wrist, else the box, else the foot
    where the box is out of reach. Ties: the user, then the smaller track. ``wrists(clip_id, frame, track_id, wx, wy)``."""
    boxes = players.filter("not transient").select("clip_id", "frame", "track_id", "is_user", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "foot_x", "foot_y", "court_x_ft", "court_y_ft")
    rows = events.join(boxes, ["clip_id", "frame"])
    if wrists is not None:
        far = wrists.join(events.select("clip_id", "frame", "x", "y"), ["clip_id", "frame"]).groupBy("clip_id", "frame", "track_id").agg(F.min(F.hypot(F.col("wx") - F.col("x"), F.col("wy") - F.col("y"))).alias("wrist"))
        rows = rows.join(far, ["clip_id", "frame", "track_id"], "left")
    else:
        rows = rows.withColumn("wrist", F.lit(None).cast("double"))
    radius = F.least(F.greatest(0.5 * F.greatest(F.lit(1.0), F.col("bbox_y2") - F.col("bbox_y1")), F.col("assoc_min_px")), F.col("assoc_max_px"))
    box, foot = bbox_distance(F.col("x"), F.col("y"), *[F.col(f"bbox_{c}") for c in ("x1", "y1", "x2", "y2")]), F.hypot(F.col("x") - F.col("foot_x"), F.col("y") - F.col("foot_y"))
    by_foot = (box > radius) & (foot < box)
    rows = rows.withColumns({"radius": radius, "d": F.coalesce("wrist", F.when(by_foot, foot).otherwise(box)), "basis": F.when(F.col("wrist").isNotNull(), "wrist").when(by_foot, "foot").otherwise("bbox")})
    best = F.min(F.struct("d", (~F.col("is_user")).alias("other"), "track_id", "basis", "radius", "is_user", "court_x_ft", "court_y_ft"))
    pick = rows.filter("d <= radius").groupBy("clip_id", "frame").agg(best.alias("b"))
    return events.join(pick, ["clip_id", "frame"]).select(*events.columns, "b.track_id", "b.is_user", "b.d", "b.basis", "b.radius", F.round("b.court_x_ft", 2).alias("hitter_x"), F.round("b.court_y_ft", 2).alias("hitter_y"), side_of_net(F.col("b.court_y_ft")).alias("hitter_side"))


def impulses(at: DataFrame) -> DataFrame:
    return at.filter((F.col("fast") >= F.col("min_ball_speed")) & ((F.col("turn") >= 45) | (F.col("ratio") >= 0.35)))


def shot_candidates(at: DataFrame) -> DataFrame:
    """The strongest impulses of the series, one in a window, and how they fare at the gates: kept, teleport or latch."""
    found = impulses(at)
    score = F.greatest(F.coalesce(F.col("turn") / 180, F.lit(0.0)), F.least(F.lit(1.0), F.col("ratio")))
    strongest = suppress_neighbours(found.select("clip_id", "frame", score.alias("score"), "impact_window"), "impact_window").select("clip_id", "frame", "score")
    rows = strongest.join(at, ["clip_id", "frame"])
    steps = around(rows, at.filter("step is not null").select("clip_id", "frame", F.col("p.frame").alias("f0"), "step"), "latch_window").filter("f0 >= at - latch_window")
    latch = steps.groupBy("clip_id", F.col("at").alias("frame")).agg(F.max("step").alias("latch"))
    gate = F.when(F.col("real") & (F.col("jump") > F.col("teleport_px")) & (F.col("run_length") < F.col("min_serve_run")), "teleport").when(F.col("real") & (F.col("latch") >= F.col("latch_px")), "latch").otherwise("kept")
    return rows.join(latch, ["clip_id", "frame"], "left").withColumn("gate", gate)


def visibility_near(events: DataFrame, at: DataFrame) -> DataFrame:
    near = around(events, at.select("clip_id", "frame", "visible"), "impact_window")
    return near.groupBy("clip_id", F.col("at").alias("frame")).agg(F.avg(F.col("visible").cast("int")).alias("quality"))


def rate(later: str, earlier: str, c: str) -> Column:
    of = lambda s, f: F.col(f"{s}.{f}") if s else F.col(f)
    return (of(later, c) - of(earlier, c)) / (of(later, "frame") - of(earlier, "frame"))


def shot_rows(cands: DataFrame, players: DataFrame, at: DataFrame, court: DataFrame, wrists: DataFrame | None = None) -> DataFrame:
    """Shots of the kept candidates that a player can have hit, with places, velocities and confidence."""
    rows = nearest_player(cands.filter("gate = 'kept'"), players, wrists).join(visibility_near(cands, at), ["clip_id", "frame"], "left").join(
        court.select("clip_id", *[f"h{i}{j}" for i in range(3) for j in range(3)]), "clip_id")
    cx, cy = project(F.col("x"), F.col("y"))
    vin, vout = [rate("", "before", c) for c in "xy"], [rate("after", "", c) for c in "xy"]
    impulse = F.greatest(F.least(F.lit(1.0), F.coalesce(F.col("turn") / 120, F.lit(0.0))), F.least(F.lit(1.0), F.col("ratio")))
    conf = 0.5 * impulse + 0.3 * (1 - F.least(F.lit(1.0), F.col("d") / F.col("radius"))) + 0.2 * F.coalesce("quality", F.lit(0.0))
    return rows.select("clip_id", "frame", F.round(F.col("frame") / F.col("fps"), 3).alias("t_sec"), "track_id", "is_user", F.lit(False).alias("is_serve"), F.lit("impulse").alias("method"),
                       F.round("x", 2).alias("impact_x"), F.round("y", 2).alias("impact_y"), F.round(cx, 2).alias("impact_court_x"), F.round(cy, 2).alias("impact_court_y"), "hitter_x", "hitter_y", "hitter_side",
                       F.round("d", 2).alias("player_px"), "basis", F.round(F.hypot(*vin), 3).alias("speed_pre"), F.round(F.hypot(*vout), 3).alias("speed_post"), F.round(turn_degrees(*vin, *vout), 1).alias("direction_change"),
                       F.round("turn", 1).alias("turn"), F.round("ratio", 3).alias("ratio"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), conf)), 3).alias("confidence"), "run_length")


def crossings(pairs: DataFrame, ball_3d: DataFrame, feet: float = CROSS_FT, frames: int = CROSS_FRAMES) -> DataFrame:
    """Those of ``pairs(clip_id, side, from, to)`` between whose frames the reconstructed ball stays beyond the net, as seen from
    ``side``, for ``frames`` frames in a row. ``ball_3d(clip_id, frame, y)``; a frame without a place breaks a row of frames.

    Rows of frames that long are few; they meet the pairs by clip, side and bucket of frames."""
    far = ball_3d.filter("y is not null").withColumn("side", F.when(F.col("y") >= NET + feet, "near").when(F.col("y") <= NET - feet, "far")).filter("side is not null").select("clip_id", "side", "frame").distinct()
    island = F.col("frame") - F.row_number().over(Window.partitionBy("clip_id", "side").orderBy("frame"))
    stays = far.withColumn("island", island).groupBy("clip_id", "side", "island").agg(F.min("frame").alias("a"), F.max("frame").alias("b")).filter(F.col("b") - F.col("a") + 1 >= frames)
    spread = lambda df, a, b: df.withColumn("bucket", F.explode(F.sequence(F.floor(F.col(a) / BUCKET), F.floor(F.col(b) / BUCKET))))
    both = spread(pairs, "from", "to").join(spread(stays.drop("island"), "a", "b"), ["clip_id", "side", "bucket"])
    return both.filter(F.least("b", "to") - F.greatest("a", "from") + 1 >= frames).select("clip_id", "side", "from", "to").distinct()


def drop_handling(shots: DataFrame, players: DataFrame, at: DataFrame, params: DataFrame, ball_3d: DataFrame | None = None) -> DataFrame:
    """Of impacts from one side with no long gap and without the ball having left in between, one stays: the last of a run
    that lasts long, else the strongest (first on ties). With ``ball_3d`` (crossings) a ball that went over the net has left
    too. Clips without a real ball keep all."""
    side = players.filter("not transient").groupBy("clip_id", "track_id").agg(side_of_net(F.percentile("court_y_ft", F.lit(0.5))).alias("side"))
    w = Window.partitionBy("clip_id").orderBy("frame")
    rows = (shots.join(side, ["clip_id", "track_id"], "left").join(params.select("clip_id", "real", "handling_reset", "handling_spread", "excursion_px"), "clip_id")
            .withColumn("prev", F.lag(F.struct("side", "frame")).over(w)))
    close = rows.filter((F.col("side") == F.col("prev.side")) & (F.col("frame") - F.col("prev.frame") <= F.col("handling_reset")))
    place = at.filter("known").select("clip_id", "frame", "x", "y")
    spans = (close.select("clip_id", F.col("frame").alias("to"), F.col("prev.frame").alias("frame"), "excursion_px").join(place, ["clip_id", "frame"])
             .select("clip_id", "to", F.col("frame").alias("from"), F.col("x").alias("x0"), F.col("y").alias("y0"), "excursion_px"))
    seen = (spans.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("from") / BUCKET), F.floor(F.col("to") / BUCKET)))).join(place.withColumn("bucket", F.floor(F.col("frame") / BUCKET)), ["clip_id", "bucket"])
            .filter("frame between `from` and `to`").groupBy("clip_id", F.col("to").alias("frame"), "excursion_px").agg(F.max(F.hypot(F.col("x") - F.col("x0"), F.col("y") - F.col("y0"))).alias("far"))
            .select("clip_id", "frame", (F.col("far") >= F.col("excursion_px")).alias("left_")))
    joined = close.select("clip_id", "frame", F.lit(True).alias("close")).join(seen, ["clip_id", "frame"], "left").filter("not coalesce(left_, false)").select("clip_id", "frame", "close")
    if ball_3d is not None:
        over = crossings(close.select("clip_id", "side", F.col("prev.frame").alias("from"), F.col("frame").alias("to")), ball_3d)
        joined = joined.join(over.select("clip_id", F.col("to").alias("frame")), ["clip_id", "frame"], "left_anti")
    runs = rows.join(joined, ["clip_id", "frame"], "left").withColumn("run", F.sum(F.when(F.col("close"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = Window.partitionBy("clip_id", "run")
    strength = F.greatest(F.coalesce(F.col("turn") / 180, F.lit(0.0)), F.least(F.lit(1.0), F.coalesce("ratio", F.lit(0.0))))
    long = F.max("frame").over(r) - F.min("frame").over(r) >= F.col("handling_spread")
    placed = runs.withColumn("long", long).withColumn("strength", strength)
    place_ = F.row_number().over(r.orderBy(F.when(F.col("long"), -F.col("frame")).otherwise(-F.col("strength")), "frame"))
    return placed.withColumn("place", place_).filter("not real or place = 1").select(*shots.columns)


def add_serves(shots: DataFrame, at: DataFrame, players: DataFrame, court: DataFrame, wrists: DataFrame | None = None) -> DataFrame:
    """Where the ball appears after a long absence and flies off, the nearest impulse in the window becomes a serve; without
    one a serve is added if a player is in reach."""
    launch = [rate("after", "", c) for c in "xy"]
    gap = F.coalesce(F.col("frame") - F.col("p.frame") - 1, F.col("serve_gap") + 1)
    starts = at.filter(F.col("starts") & (gap >= F.col("serve_gap")) & (F.hypot(*launch) >= F.col("min_ball_speed")) & (~F.col("real") | (F.col("run_length") >= F.col("min_serve_run"))))
    near = around(starts, shots.select("clip_id", "frame"), "impact_window").groupBy("clip_id", F.col("at").alias("start")).agg(F.min(F.struct(F.abs(F.col("frame") - F.col("at")).alias("d"), "frame"))["frame"].alias("frame"))
    promoted = shots.join(near.select("clip_id", "frame", F.lit(True).alias("appears")).distinct(), ["clip_id", "frame"], "left").withColumns(
        {"is_serve": F.coalesce("appears", F.lit(False)), "method": F.when(F.col("appears"), "impulse+serve").otherwise(F.col("method"))}).select(*shots.columns)
    alone = starts.join(near.select("clip_id", F.col("start").alias("frame")), ["clip_id", "frame"], "left_anti")
    rows = nearest_player(alone, players, wrists).join(visibility_near(alone, at), ["clip_id", "frame"], "left").join(court.select("clip_id", *[f"h{i}{j}" for i in range(3) for j in range(3)]), "clip_id")
    cx, cy = project(F.col("x"), F.col("y"))
    conf = 0.4 + 0.4 * (1 - F.least(F.lit(1.0), F.col("d") / F.col("radius"))) + 0.2 * F.coalesce("quality", F.lit(0.0))
    null = lambda c: F.lit(None).cast("double").alias(c)
    added = rows.select("clip_id", "frame", F.round(F.col("frame") / F.col("fps"), 3).alias("t_sec"), "track_id", "is_user", F.lit(True).alias("is_serve"), F.lit("serve").alias("method"), F.round("x", 2).alias("impact_x"),
                        F.round("y", 2).alias("impact_y"), F.round(cx, 2).alias("impact_court_x"), F.round(cy, 2).alias("impact_court_y"), "hitter_x", "hitter_y", "hitter_side", F.round("d", 2).alias("player_px"), "basis", null("speed_pre"),
                        F.round(F.hypot(*launch), 3).alias("speed_post"), null("direction_change"), null("turn"), null("ratio"), F.round(F.least(F.lit(1.0), conf), 3).alias("confidence"), "run_length")
    return promoted.unionByName(added)


def drop_double_serves(shots: DataFrame, params: DataFrame) -> DataFrame:
    """Of two serves close together without an impulse between, the one of the shorter run goes."""
    w = Window.partitionBy("clip_id").orderBy("frame")
    hit = F.col("method").startswith("impulse").cast("long")
    counted = shots.withColumns({"upto": F.sum(hit).over(w), "before": F.sum(hit).over(w) - hit}).join(params.select("clip_id", "real", "serve_dedup"), "clip_id")
    serves = counted.filter("is_serve and real").select("clip_id", "frame", "before", "upto", "run_length", "serve_dedup")
    kept = dedup_serves(serves, "serve_dedup").select("clip_id", "frame")
    return shots.join(serves.select("clip_id", "frame").join(kept, ["clip_id", "frame"], "left_anti"), ["clip_id", "frame"], "left_anti")


def drop_ground_balls(shots: DataFrame, at: DataFrame, court: DataFrame, most: float = 0.70) -> DataFrame:
    cx, cy = project(F.col("x"), F.col("y"))
    ground = at.filter("known and real").join(court.select("clip_id", *[f"h{i}{j}" for i in range(3) for j in range(3)]), "clip_id").select("clip_id", "frame", F.coalesce(in_rect(cx, cy, 8, 8), F.lit(False)).cast("int").alias("near"))
    share = around(shots.join(at.select("clip_id", "frame", "grounded_window"), ["clip_id", "frame"]), ground, "grounded_window").groupBy("clip_id", F.col("at").alias("frame")).agg(F.avg("near").alias("share"), F.count("*").alias("n"))
    return shots.join(share.filter((F.col("n") >= 6) & (F.col("share") >= most)), ["clip_id", "frame"], "left_anti")


def point_marks(shots: DataFrame, params: DataFrame) -> DataFrame:
    """``shots`` with what points are made of: returned (the other side plays it in time; null where the side is unknown),
    candidate (from behind the baseline after a pause: it may be a serve) and is_end (nobody returns it, and a pause follows)."""
    w = Window.partitionBy("clip_id").orderBy("frame")
    back = Window.partitionBy("clip_id").orderBy(F.desc("frame")).rangeBetween(Window.unboundedPreceding, -1)
    nxt = lambda side: F.min(F.when(F.col("hitter_side") == side, F.col("frame"))).over(back)
    p = params.select("clip_id", "real", "open_gap", "return_frames", "dead_gap", "inter_serve")
    other = F.when(F.col("hitter_side") == "near", F.col("next_far")).when(F.col("hitter_side") == "far", F.col("next_near"))
    rows = shots.join(p, "clip_id").withColumns({"next_near": nxt("near"), "next_far": nxt("far"), "gap_before": F.col("frame") - F.lag("frame").over(w), "gap_after": F.lead("frame").over(w) - F.col("frame")}).withColumns({
        "returned": F.when(F.col("hitter_side").isNotNull(), F.coalesce(other - F.col("frame") <= F.col("return_frames"), F.lit(False))),
        "candidate": (F.abs(F.coalesce("hitter_y", F.lit(22.0)) - 22) >= 21) & F.coalesce(F.col("gap_before") >= F.col("open_gap"), F.lit(True))})
    return rows.withColumn("is_end", ~F.col("candidate") & F.coalesce(~F.col("returned"), F.lit(False)) & F.coalesce(F.col("gap_after") >= F.col("dead_gap"), F.lit(True)))


def point_structure(shots: DataFrame, params: DataFrame) -> DataFrame:
    """Serves by the structure of points, and shots after a point's end before the next serve (is_between_point)."""
    w = Window.partitionBy("clip_id").orderBy("frame")
    rows = point_marks(shots, params)
    serves = accept_serves(rows.filter("real").select("clip_id", "frame", "candidate", "is_end", "returned", "inter_serve"))
    marked = rows.join(serves.select("clip_id", "frame", F.lit(True).alias("accepted")), ["clip_id", "frame"], "left")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    point = marked.withColumns({"point": F.count("accepted").over(upto), "is_serve": F.when(F.col("real"), F.coalesce("accepted", F.lit(False))).otherwise(F.col("is_serve"))})
    last_end = F.max(F.when(F.col("is_end"), F.col("frame"))).over(Window.partitionBy("clip_id", "point"))
    return point.withColumn("is_between_point", F.col("real") & (F.col("point") > 0) & F.coalesce(F.col("frame") > last_end, F.lit(False))).select(*shots.columns, "is_between_point")


#: Steps of the chain in order: a candidate's fate is the first step that it doesn't reach.
STEPS = ("candidate", "strongest", "no_teleport", "no_latch", "has_player", "no_handling", "single_serve", "no_repeat", "airborne")
#: What a candidate is counted as when it goes at the next step.
LOST = ("merged_duplicates", "rejected_teleport_in", "rejected_latch", "rejected_no_player", "rejected_handling", "rejected_serve_twice", "rejected_repeat", "rejected_ground_ball", "shots")


def detect_steps(ball: DataFrame, players: DataFrame, court: DataFrame, wrists: DataFrame | None = None, ball_3d: DataFrame | None = None) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """(shots, the written table of each of STEPS, the series) of the whole chain: ball, players and ``court`` (with ``real``)."""
    params = written(scaled_params(court).join(court.select("clip_id", "real"), "clip_id"))
    at = written(series(ball, params))  # steps use what came before several times: each is written once
    found = written(shot_candidates(at))
    steps = {"candidate": impulses(at), "strongest": found, "no_teleport": found.filter("gate <> 'teleport'"), "no_latch": found.filter("gate = 'kept'")}
    shots = steps["has_player"] = written(shot_rows(found, players, at, court, wrists))
    shots = steps["no_handling"] = written(drop_handling(shots, players, at, params, ball_3d))
    served = written(add_serves(shots, at, players, court, wrists))
    steps["serves"] = served.filter("method = 'serve'")
    shots = steps["single_serve"] = written(drop_double_serves(served, params))
    real = params.select("clip_id", "real", "rally_gap")
    held = same_track_repeats(shots.join(real.filter("real"), "clip_id").withColumn("shot_id", F.col("frame")).select("clip_id", "shot_id", "frame", "track_id", "is_serve", "rally_gap"), "rally_gap").select("clip_id", "frame")
    shots = steps["no_repeat"] = written(shots.join(real.filter("real").select("clip_id"), "clip_id", "left_anti").unionByName(shots.join(held, ["clip_id", "frame"], "left_semi")))
    shots = steps["airborne"] = written(drop_ground_balls(shots, at, court))
    shots = point_structure(shots, params)
    return shots.withColumn("shot_id", F.row_number().over(Window.partitionBy("clip_id").orderBy("frame")) - 1), steps, at


def detect_shots(ball: DataFrame, players: DataFrame, court: DataFrame, wrists: DataFrame | None = None, ball_3d: DataFrame | None = None) -> DataFrame:
    """The whole chain: ball, players and ``court`` (with ``real``) to numbered shots."""
    return detect_steps(ball, players, court, wrists, ball_3d)[0]


def shot_fates(steps: dict[str, DataFrame]) -> DataFrame:
    """(clip_id, frame, served, fate) of each candidate and of each serve that was added: one of LOST, from the furthest step
    that it reached. The steps' keys are grouped once."""
    reached = None
    for k, name in enumerate(STEPS):
        served = F.col("method") == "serve" if "method" in steps[name].columns else F.lit(False)
        rows = steps[name].select("clip_id", "frame", F.lit(k).alias("step"), served.alias("served"))
        reached = rows if reached is None else reached.unionByName(rows)
    reached = reached.unionByName(steps["serves"].select("clip_id", "frame", F.lit(STEPS.index("no_handling")).alias("step"), F.lit(True).alias("served")))
    fate = F.element_at(F.array(*[F.lit(x) for x in LOST]), F.max("step") + 1)
    return reached.groupBy("clip_id", "frame", "served").agg(fate.alias("fate"))


def rejection_stats(shots: DataFrame, steps: dict[str, DataFrame], at: DataFrame) -> DataFrame:
    """One row per clip: candidates and added serves, what each of LOST took (these add up), impulses that were too slow or lie
    in gaps, dropped teleports, serves, the share of frames with a ball, and the frames looked at."""
    fates = shot_fates(steps).groupBy("clip_id").agg(F.count_if("served").alias("serves_added"), F.count_if(~F.col("served")).alias("candidates"), *[F.count_if(F.col("fate") == x).alias(x) for x in LOST])
    impulse = (F.col("turn") >= 45) | (F.col("ratio") >= 0.35)
    hidden = F.col("turn").isNull() & F.col("known") & F.col("before").isNotNull() & F.col("after").isNotNull() & (turn_degrees(*[rate("", "before", c) for c in "xy"], *[rate("after", "", c) for c in "xy"]) >= 45)
    frames = at.groupBy("clip_id").agg(F.count_if((F.col("fast") < F.col("min_ball_speed")) & impulse).alias("rejected_low_speed"), F.count_if(hidden).alias("rejected_ball_gap"), F.count_if("dropped").alias("teleports_dropped"),
                                       F.avg(F.col("visible").cast("int")).alias("ball_visible_share"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"))
    kinds = shots.groupBy("clip_id").agg(F.count_if("is_serve").alias("serves"), F.count_if("is_between_point").alias("between_points"))
    counted = [c for c in fates.columns + kinds.columns if c != "clip_id"]
    return frames.join(fates, "clip_id", "left").join(kinds, "clip_id", "left").na.fill(0, counted)
