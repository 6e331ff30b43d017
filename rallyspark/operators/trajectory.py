"""From contact to landing: speeds, arcs, bounces between shots, shot context and types; the ball's size and height."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.geometry import KITCHEN, NET, local_px_per_ft, px_per_ft, zone
from ..sources.readers import written
from .ball import KNOWN
from .poses import scenes
from .shots import CLIP, between_shots, last_shot
from .tile_scenes import scene, scenes_by_tile


def ORDER():  # noqa: N802
    return CLIP().orderBy("frame", "shot_id")


def landing(bounces: DataFrame, shots: DataFrame) -> DataFrame:
    """The first bounce after each shot (ties: smaller id) that has a place on the court."""
    linked = between_shots(bounces, shots).filter("prev_shot is not null").select("clip_id", "bounce_id", "frame", "prev_shot")
    placed = linked.join(bounces.select("clip_id", "bounce_id", "court_x_ft", "court_y_ft"), ["clip_id", "bounce_id"]).filter("court_y_ft is not null")
    first = placed.groupBy("clip_id", F.col("prev_shot").alias("shot_id")).agg(F.min(F.struct("frame", "bounce_id", "court_x_ft", "court_y_ft")).alias("b"))
    return first.select("clip_id", "shot_id", F.col("b.frame").alias("land_frame"), F.col("b.court_x_ft").alias("land_x"), F.col("b.court_y_ft").alias("land_y"))


def speed_to_anchor(most_s: float = 1.5, least_s: float = 0.1, most_ft: float = 44.0, slack: float = 2.0) -> Column:
    """Struct (anchor, speed, confidence) by frame, front_x, front_y, land_frame, land_x, land_y, fps and next_ (f, x, y), as anchored_speed() says."""
    def end(frame: Column, x: Column, y: Column, kind: str, base: float, longest: float | None) -> Column:
        air, far = (frame - F.col("frame")) / F.col("fps"), F.hypot(x - F.col("front_x"), y - F.col("front_y"))
        low, high = F.least(y, F.col("front_y")), F.greatest(y, F.col("front_y"))
        ok = (air >= least_s) & (far <= most_ft) & (low <= NET + slack) & (high >= NET - slack)
        sure = base * F.when((low < -3) | (high > 47), 0.5).otherwise(1.0) * F.when(air < 0.15, 0.5).otherwise(1.0)
        return F.when(ok & (air <= longest) if longest else ok, F.struct(F.lit(kind).alias("anchor"), F.round(far / air, 6).alias("speed"), sure.alias("confidence")))

    return F.coalesce(end(F.col("land_frame"), F.col("land_x"), F.col("land_y"), "bounce", 0.85, None), end(F.col("next_.f"), F.col("next_.x"), F.col("next_.y"), "contact", 0.6, most_s))


def next_contact(order: WindowSpec) -> Column:
    """The next shot's frame and front foot (f, x, y), null if that is a serve."""
    nxt = lambda c: F.lead(c).over(order)
    return F.when(~nxt("is_serve"), nxt(F.struct(F.col("frame").alias("f"), F.col("front_x").alias("x"), F.col("front_y").alias("y"))))


def anchored_speed(shots: DataFrame, landed: DataFrame, feet: DataFrame, court: DataFrame) -> DataFrame:
    """Ground speed from the hitter's front foot to the landing, else to the next contact unless that is a serve.

    The first end point with enough airtime, a range within the court and a crossing of the net counts.
    """
    at = shots.join(feet, ["clip_id", "frame", "track_id"]).select("clip_id", "shot_id", "frame", "is_serve", "front_x", "front_y")
    rows = at.withColumn("next_", next_contact(ORDER())).join(landed, ["clip_id", "shot_id"], "left").join(court.select("clip_id", "fps"), "clip_id")
    return rows.withColumn("best", speed_to_anchor()).filter("best is not null").select("clip_id", "shot_id", "best.anchor", "best.speed", "best.confidence")


def speed_by_tile(shots: DataFrame, bounces: DataFrame, contacts: DataFrame, poses: DataFrame, court: DataFrame) -> DataFrame:
    """anchored_speed() with landing() and front_feet() of the tables, in one pass per tile of frames."""
    speed = lambda rows: with_speed(rows.withColumn("front_", F.explode_outer("feet_")).withColumns({"front_x": F.col("front_.x"), "front_y": F.col("front_.y")}))
    columns = [F.col(c) for c in ("clip_id", "shot_id", "best.anchor", "best.speed", "best.confidence")]
    return scenes_by_tile(shots, contacts, poses, bounces.filter("court_y_ft is not null"), court, speed, columns, F.col("best").isNotNull(), hits=False, speeds=True)


def with_speed(rows: DataFrame) -> DataFrame:
    """Adds the best speed to scenes with contact_, the next shot whose hitter a contact shows; of several front feet only the last is followed by it."""
    ahead = F.when(F.col("front_.last") & ~F.col("contact_.is_serve"), F.struct(F.col("contact_.frame").alias("f"), F.col("contact_.x").alias("x"), F.col("contact_.y").alias("y")))
    return rows.withColumn("next_", ahead).withColumn("best", F.when(F.col("stand_").isNotNull(), speed_to_anchor()))


def flight_points(shots: DataFrame, ball: DataFrame, most: int = 90) -> DataFrame:
    """Known ball points from a contact to the frame before the next, or ``most`` frames on if that is far."""
    points = last_shot(ball.filter(KNOWN()).select("clip_id", "frame", "pixel_x", "pixel_y"), shots).filter(F.col("frame") <= F.col("at") + most)
    return points.select("clip_id", "shot_id", "frame", "pixel_x", "pixel_y")


def arc_height(points: DataFrame) -> DataFrame:
    """Largest rise over the chord from a flight's first to its last point, over the chord's length; null under 3 points."""
    w = Window.partitionBy("clip_id", "shot_id")
    here = F.struct("frame", "pixel_x", "pixel_y")
    rows = points.withColumn("a", F.min(here).over(w)).withColumn("b", F.max(here).over(w))
    t = F.try_divide(F.col("frame") - F.col("a.frame"), F.col("b.frame") - F.col("a.frame"))
    up = F.col("a.pixel_y") + t * (F.col("b.pixel_y") - F.col("a.pixel_y")) - F.col("pixel_y")
    chord = F.hypot(F.col("b.pixel_x") - F.col("a.pixel_x"), F.col("b.pixel_y") - F.col("a.pixel_y"))
    out = rows.groupBy("clip_id", "shot_id").agg(F.count("*").alias("n"), F.greatest(F.lit(0.0), F.max(up)).alias("up"), F.max(chord).alias("chord"))
    return out.select("clip_id", "shot_id", F.round(F.when(F.col("n") >= 3, F.try_divide("up", F.when(F.col("chord") >= 1e-9, F.col("chord")))), 6).alias("arc"))


def bounced_between(shots: DataFrame, ball: DataFrame, fall: float = 14.0, rise: float = 20.0, around: int = 4) -> DataFrame:
    """Whether the ball comes down and rebounds between a shot and the one before; null under 5 known points."""
    between = last_shot(ball.filter(KNOWN()).select("clip_id", "frame", "pixel_y"), shots).filter("frame > at and next_shot is not null")
    points = between.select("clip_id", F.col("next_shot").alias("shot_id"), "frame", "pixel_y")
    w = Window.partitionBy("clip_id", "shot_id").orderBy("frame")
    y = F.col("pixel_y")
    rows = points.select("clip_id", "shot_id", y, F.row_number().over(w).alias("place"), F.count("*").over(Window.partitionBy("clip_id", "shot_id")).alias("n"), F.max(y).over(w.rowsBetween(-around, around)).alias("top"),
                         F.min(y).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.min(y).over(w.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    hit = (F.col("place") > 2) & (F.col("place") <= F.col("n") - 2) & (y == F.col("top")) & (y - F.col("before") >= fall) & (y - F.col("after") >= rise)
    return rows.groupBy("clip_id", "shot_id").agg(F.when(F.max("n") >= 5, F.bool_or(hit)).alias("bounced"))


def scenes_landed(shots: DataFrame, contacts: DataFrame, poses: DataFrame, court: DataFrame, landed: DataFrame) -> DataFrame:
    """Shots with returns, what stands on their frame and their landing."""
    rows = shots.select("clip_id", "shot_id", "frame", "track_id", "is_serve", F.lead("track_id").over(ORDER()).alias("next_track"),
                        F.coalesce(F.lag("is_serve").over(ORDER()) & (F.lag("hitter_side").over(ORDER()) != F.col("hitter_side")), F.lit(False)).alias("is_return"))
    return scenes(rows, contacts, poses, court).join(landed, ["clip_id", "shot_id"], "left")


def context_measures() -> list[Column]:
    ppf = px_per_ft(F.coalesce("court_y_ft", F.lit(NET)), F.col("near_px_per_ft"), F.col("far_px_per_ft"))
    same = ((F.col("court_y_ft") >= NET) == (F.col("land_y") >= NET)) & (F.abs(F.col("land_y") - NET) > KITCHEN)
    return [zone(F.coalesce("front_y", F.lit(NET))).alias("zone"), zone(F.col("receiver_y")).alias("receiver_zone"), F.when(~F.coalesce(same, F.lit(False)), F.col("land_y")).alias("landing_y"),
            F.round(F.col("speed_pre") * F.col("fps") / ppf, 6).alias("pre_ftps"), F.round(F.col("speed_post") * F.col("fps") / ppf, 6).alias("post_ftps")]


def context_columns() -> list[Column]:
    return [*map(F.col, ("clip_id", "shot_id", "is_serve", "is_return")), *context_measures(), F.col("height")]


def shot_context(shots: DataFrame, contacts: DataFrame, poses: DataFrame, court: DataFrame, landed: DataFrame) -> DataFrame:
    """Per shot what its type rests on: zones of hitter and receiver on this frame, landing, return, pixel speeds, contact height."""
    return scenes_landed(shots, contacts, poses, court, landed).select(*context_columns())


def context_by_tile(shots: DataFrame, bounces: DataFrame, contacts: DataFrame, poses: DataFrame, court: DataFrame) -> DataFrame:
    """shot_context() with landing() of the bounces, in one pass per tile of frames."""
    return scenes_by_tile(shots, contacts, poses, bounces.filter("court_y_ft is not null"), court, scene, context_columns())


def speed_for_type(rows: DataFrame, least: float = 0.6) -> DataFrame:
    """Adds the speed and its two thresholds: the anchored one (``best``) if sure and not a volley that rests on a bounce, else the pixel speed."""
    use = F.coalesce((F.col("best.confidence") >= least) & ~(F.col("volley") & (F.col("best.anchor") == "bounce")), F.lit(False))
    pick = lambda a, b: F.when(use, a).otherwise(b)
    return rows.withColumn("speed", pick(F.col("best.speed"), F.col("post_ftps"))).withColumn("drive_min", pick(26.0, 25.0)).withColumn("dink_max", pick(23.0, 16.0)).drop("best")


#: fixed values: arc shares of a lob and of a lofted ball, speed of an incoming ball that is reset
LOB_ARC, LOFT_ARC, RESET_SPEED = 0.35, 0.15, 25.0


def type_columns() -> list[Column]:
    """Type and confidence by the first rule that fits; without a landing the confidences are low."""
    c = F.col
    fast, slow = F.coalesce(c("speed") >= c("drive_min"), F.lit(False)), F.coalesce(c("speed") <= c("dink_max"), F.lit(False))
    arc_over = lambda least: F.coalesce(c("arc") >= least, F.lit(False))
    lofted, lob = F.when(c("arc").isNull(), slow).otherwise(arc_over(LOFT_ARC)), F.when(c("arc").isNull(), slow).otherwise(arc_over(LOB_ARC))
    landed, deep, down = c("landing_y").isNotNull(), c("zone") == "baseline", zone(c("landing_y"))
    rules = [(c("is_serve"), "serve", 0.95), (c("is_return"), "return", 0.9), (c("volley") & (c("zone") == "kitchen") & ~fast, "dink", 0.35), (c("volley"), "drive", 0.40),
             (arc_over(LOB_ARC) & ~fast & (c("receiver_zone") == "kitchen"), "lob", F.least(F.lit(1.0), F.greatest(F.lit(0.6), c("arc")))),
             (landed & deep & (down == "kitchen"), "drop", 0.78), (landed & deep, "drive", 0.78), (landed & (down == "kitchen"), "dink", 0.78), (landed & (down == "transition") & lofted, "dink", 0.7),
             (landed & (down == "baseline") & lob, "lob", 0.7), (landed, "drive", 0.78), (fast, "drive", 0.40), (slow & ~deep & (c("pre_ftps") >= RESET_SPEED), "reset", 0.35),
             (slow & ~deep, "dink", 0.35), (slow, "drop", 0.30), (c("speed").isNotNull() & arc_over(LOFT_ARC), "drop", 0.25), (c("speed").isNotNull(), "drive", 0.25)]
    kind = sure = None
    for when, name, confidence in rules:
        value = confidence if isinstance(confidence, Column) else F.lit(confidence)
        kind = F.when(when, name) if kind is None else kind.when(when, name)
        sure = F.when(when, value) if sure is None else sure.when(when, value)
    return [kind.otherwise("unknown").alias("shot_type"), sure.otherwise(0.20).alias("confidence")]


def classify_type(rows: DataFrame) -> DataFrame:
    return rows.select("clip_id", "shot_id", *type_columns())


def typed_shots(shots: DataFrame, ball: DataFrame, bounces: DataFrame, contacts: DataFrame, poses: DataFrame, court: DataFrame, linked: DataFrame) -> DataFrame:
    """The whole typing: context, volleys by the flight before (else by the listed bounces), speeds, arcs, then the rules."""
    # Speeds run over the shots whose hitter a contact shows, on the same rows as the context.
    rows = scenes_landed(shots, contacts, poses, court, landing(bounces, shots))
    best = F.when(F.col("standing"), speed_to_anchor()).alias("best")
    context = rows.withColumn("next_", next_contact(Window.partitionBy("clip_id", "standing").orderBy("frame", "shot_id"))).select(*context_columns(), best)
    listed = linked.filter("next_shot is not null").select("clip_id", F.col("next_shot").alias("shot_id")).distinct().withColumn("listed", F.lit(True))
    first = shots.groupBy("clip_id").agg(F.min_by("shot_id", F.struct("frame", "shot_id")).alias("first_shot"))
    volley = ~F.coalesce("bounced", "listed", F.lit(False)) & ~F.col("is_serve") & (F.col("shot_id") != F.col("first_shot"))
    rows = (context.join(bounced_between(shots, ball), ["clip_id", "shot_id"], "left").join(listed, ["clip_id", "shot_id"], "left").join(first, "clip_id").withColumn("volley", volley)
            .join(arc_height(flight_points(shots, ball)), ["clip_id", "shot_id"], "left"))
    return classify_type(speed_for_type(rows))


def in_reach(shots: DataFrame, ball: DataFrame) -> DataFrame:
    """Shots up to the first after a clip's last known ball, which bounds the one before."""
    ends = F.broadcast(ball.filter(KNOWN()).groupBy("clip_id").agg(F.max("frame").alias("last_")))  # one row per clip
    stops = F.broadcast(shots.join(ends, "clip_id").filter("frame > last_").groupBy("clip_id").agg(F.min("frame").alias("stop_")))
    return shots.join(ends, "clip_id").join(stops, "clip_id", "left").filter("frame <= coalesce(stop_, last_)").select("clip_id", "frame", "shot_id")


def typed_by_tile(shots: DataFrame, ball: DataFrame, bounces: DataFrame, contacts: DataFrame, poses: DataFrame, court: DataFrame) -> DataFrame:
    """typed_shots() in one pass per tile of frames, which only the shots in the ball's reach bring their flights to."""
    near, keys = written(in_reach(shots, ball)), ["clip_id", "shot_id"]
    flights = near.join(arc_height(flight_points(near, ball)), keys, "left").join(bounced_between(near, ball), keys, "left").filter("arc is not null or bounced is not null")

    def of_flight(name: str) -> Column:
        return F.array_max(F.transform(F.filter("flights_", lambda f: f["shot_id"] == F.col("shot_id")), lambda f: f[name]))

    def typed(rows: DataFrame) -> DataFrame:
        rows = with_speed(scene(rows.withColumns({"arc": of_flight("arc"), "bounced": of_flight("bounced")})))
        listed = F.col("fell_").isNotNull() & (F.col("earlier_").isNull() | (F.col("fell_") >= F.col("earlier_.frame")))
        volley = ~F.coalesce("bounced", listed, F.lit(False)) & ~F.col("is_serve") & F.col("earlier_").isNotNull()
        return speed_for_type(rows.withColumn("volley", volley).select("*", *context_measures()))

    columns = [F.col("clip_id"), F.col("shot_id"), *type_columns()]
    return scenes_by_tile(shots, contacts, poses, bounces, court, typed, columns, speeds=True, flights=flights)


# ---- the ball's size and height

def camera_ground(contacts: DataFrame, every: int = 4, least: int = 20, height: float = 5.6) -> DataFrame:
    """Least-squares meeting point of the lines from feet to heads, and the camera's height from the median share of the way.

    Each line adds I - dd' and its product with the foot to sums per clip; the 2 x 2 system is solved in closed form.
    Clips with fewer than ``least`` rows or lines that are all parallel give null.
    """
    hx, hy = (F.col("bbox_x1") + F.col("bbox_x2")) / 2, F.col("bbox_y1")
    rows = contacts.filter(F.col("in_court") & (F.col("frame") % every == 0)).withColumn("hx", hx).withColumn("hy", hy)
    dx, dy = F.col("hx") - F.col("foot_x"), F.col("hy") - F.col("foot_y")
    length = F.hypot(dx, dy)
    lines = rows.withColumn("ux", dx / length).withColumn("uy", dy / length).filter("ux is not null")
    a, b, d = 1 - F.col("ux") * F.col("ux"), -F.col("ux") * F.col("uy"), 1 - F.col("uy") * F.col("uy")
    sums = lines.groupBy("clip_id").agg(F.count("*").alias("n_rows"), F.sum(a).alias("a"), F.sum(b).alias("b"), F.sum(d).alias("d"),
                                        F.sum(a * F.col("foot_x") + b * F.col("foot_y")).alias("p"), F.sum(b * F.col("foot_x") + d * F.col("foot_y")).alias("q"))
    det = F.when((F.col("n_rows") >= least) & (F.abs(F.col("a") * F.col("d") - F.col("b") * F.col("b")) > 1e-9), F.col("a") * F.col("d") - F.col("b") * F.col("b"))
    meet = sums.select("clip_id", "n_rows", ((F.col("p") * F.col("d") - F.col("q") * F.col("b")) / det).alias("ground_x"), ((F.col("q") * F.col("a") - F.col("p") * F.col("b")) / det).alias("ground_y"))
    k = F.try_divide(F.hypot(F.col("ground_x") - F.col("foot_x"), F.col("ground_y") - F.col("foot_y")), F.hypot(F.col("ground_x") - F.col("hx"), F.col("ground_y") - F.col("hy")))
    share = lines.join(meet, "clip_id").groupBy("clip_id", "n_rows", "ground_x", "ground_y").agg(F.percentile(k, F.lit(0.5)).alias("k"))
    return share.withColumn("camera_ft", F.when(F.col("k") > 1, height / (1 - 1 / F.col("k"))))


def size_calibration(sizes: DataFrame, most: float = 2.0, least: int = 8, slope: float = 0.2) -> DataFrame:
    """Line from predicted to measured size at bounces, without ratios of ``most`` or more; few rows or a flat line give the fixed one."""
    fit = sizes.filter(F.col("at_bounce") & (F.col("measured_px") / F.col("predicted_px") < most)).groupBy("clip_id").agg(
        F.regr_slope("measured_px", "predicted_px").alias("s"), F.regr_intercept("measured_px", "predicted_px").alias("i"), F.regr_count("measured_px", "predicted_px").alias("n"))
    rows = sizes.select("clip_id").distinct().join(fit, "clip_id", "left")
    ok = F.coalesce((F.col("n") >= least) & (F.col("s") > slope), F.lit(False))
    return rows.select("clip_id", F.when(ok, F.round("s", 6)).otherwise(1.25).alias("slope"), F.when(ok, F.round("i", 6)).otherwise(2.5).alias("intercept"), ok.alias("fitted"))


def reconstruct_3d(sizes: DataFrame, calibration: DataFrame, camera_x: float = 10.0, camera_y: float = -15.0, camera_z: float = 12.0) -> DataFrame:
    """Ball place from its size: it lies on the ray from the camera to its ground point, nearer by measured over predicted size."""
    true = F.greatest((F.col("measured_px") - F.col("intercept")) / F.col("slope"), F.lit(0.1))
    rows = sizes.join(calibration, "clip_id").withColumn("k", F.greatest(F.lit(1.0), true / F.col("predicted_px")))
    along = lambda eye, ground: eye + (F.col(ground) - eye) / F.col("k")
    return rows.select("clip_id", "frame", "at_bounce", "ground_x", "ground_y", along(camera_x, "ground_x").alias("x"), along(camera_y, "ground_y").alias("y"), (camera_z * (1 - 1 / F.col("k"))).alias("z"))


def reconstruction_report(points: DataFrame, side: float = 5.0, end: float = 15.0) -> DataFrame:
    """Shares inside the play envelope before and after, and the median height at bounces, which should be near nought."""
    inside = lambda x, y: F.avg((F.col(x).between(-side, 20 + side) & F.col(y).between(-end, 44 + end)).cast("int"))
    return points.groupBy("clip_id").agg(inside("ground_x", "ground_y").alias("inside_raw"), inside("x", "y").alias("inside_3d"), F.percentile(F.when(F.col("at_bounce"), F.col("z")), F.lit(0.5)).alias("median_bounce_z"))


def ball_scale(ball: DataFrame, court: DataFrame) -> DataFrame:
    return ball.filter(KNOWN()).join(court, "clip_id").select("clip_id", "frame", F.round(local_px_per_ft(F.col("pixel_x"), F.col("pixel_y")), 4).alias("px_per_ft"))


def size_separability(sizes: DataFrame) -> DataFrame:
    """Deciles and quartiles of measured over predicted size for bounces and flight, and the AUC from mean ranks.

    Ratios are counted per distinct value first; ranks are running counts over these, so there is no pair join.
    """
    ratio = F.col("measured_px") / F.col("predicted_px")
    rows = sizes.withColumn("ratio", ratio)
    spread = lambda kind: [F.percentile(F.when(kind, F.col("ratio")), F.lit(q)) for q in (0.1, 0.25, 0.5, 0.75, 0.9)]
    names = ("p10", "p25", "p50", "p75", "p90")
    wide = rows.groupBy("clip_id").agg(*[v.alias(f"bounce_{n}") for v, n in zip(spread(F.col("at_bounce")), names)], *[v.alias(f"flight_{n}") for v, n in zip(spread(~F.col("at_bounce")), names)])
    ties = rows.groupBy("clip_id", "ratio").agg(F.count_if("at_bounce").alias("b"), F.count_if(~F.col("at_bounce")).alias("f"))
    below = F.coalesce(F.sum("b").over(Window.partitionBy("clip_id").orderBy("ratio").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    auc = ties.withColumn("wins", F.col("f") * (below + F.col("b") / 2)).groupBy("clip_id").agg(F.try_divide(F.sum("wins"), F.sum("b") * F.sum("f")).alias("auc"))
    return wide.join(auc, "clip_id")
