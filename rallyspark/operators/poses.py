"""Body measures at contact as column expressions, and reports on pose coverage.

Pose columns are named by side (l, r), landmark (s shoulder, h hip, k knee, a ankle, w wrist) and part (x, y, v); a missing
visibility counts as seen, a missing coordinate as unseen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import NET, image_of, project, turn_degrees, zone


def point(name: str, floor: float) -> tuple[Column, Column]:
    """x and y of a landmark, null unless it is seen at ``floor`` or better."""
    seen = (F.coalesce(F.col(f"{name}v"), F.lit(1.0)) >= floor) & F.col(f"{name}x").isNotNull() & F.col(f"{name}y").isNotNull()
    return F.when(seen, F.col(f"{name}x")), F.when(seen, F.col(f"{name}y"))


def mean_of(a: Column, b: Column) -> Column:
    """Mean of the two, or the one that is present; null if none is."""
    return F.coalesce((a + b) / 2, a, b)


def knee_angle(floor: float = 0.3) -> Column:
    """Mean hip-knee-ankle angle in degrees over the legs that are seen whole, to a tenth."""
    legs = []
    for side in "lr":
        (hx, hy), (kx, ky), (ax, ay) = (point(side + part, floor) for part in "hka")
        legs.append(turn_degrees(hx - kx, hy - ky, ax - kx, ay - ky))
    return F.round(mean_of(*legs), 1)


def contact_front(hand: Column, y: Column, floor: float = 0.3) -> Column:
    """How far the hitting wrist is ahead of the hips along the picture's direction to the net, in shoulder widths."""
    (lx, ly), (rx, ry) = point("lw", floor), point("rw", floor)
    wx, wy = F.when(hand == "right", rx).when(hand == "left", lx), F.when(hand == "right", ry).when(hand == "left", ly)
    width = F.abs(F.col("rsx") - F.col("lsx"))
    here = image_of(F.lit(10.0), y)
    ahead = image_of(F.lit(10.0), y + F.when(y < NET, 1.0).otherwise(-1.0))
    nx, ny = ahead[0] - here[0], ahead[1] - here[1]
    ox, oy = wx - (F.col("lhx") + F.col("rhx")) / 2, wy - (F.col("lhy") + F.col("rhy")) / 2
    return F.try_divide(ox * nx + oy * ny, F.hypot(nx, ny) * F.when(width >= 1e-9, width))


def contact_height(y: Column, floor: float = 0.5) -> Column:
    """``high`` at or above the shoulders, ``low`` at or below the hips, else (or unseen) ``mid``."""
    shoulders, hips = (mean_of(point("l" + part, floor)[1], point("r" + part, floor)[1]) for part in "sh")
    return height_among(y, shoulders, hips)


def height_among(y: Column, shoulders: Column, hips: Column) -> Column:
    return F.when(y <= shoulders, "high").when(y >= hips, "low").otherwise("mid")


def stroke_side(x: Column, hand: Column, serve: Column, floor: float = 0.5, least: float = 0.35) -> Column:
    """Struct (side, confidence): on which side of the shoulders' middle the ball is met, by the hand and the facing.

    Under ``least`` the side is unknown; a serve of unknown side by a known hand is a forehand at 0.6 or more.
    """
    (lx, _), (rx, _) = point("ls", floor), point("rs", floor)
    off = x - (lx + rx) / 2
    share = F.abs(off) / (0.5 * F.when(F.abs(rx - lx) >= 1e-9, F.abs(rx - lx)))
    sure = F.when(hand.isin("left", "right") & share.isNotNull(), F.round(F.least(F.lit(1.0), share), 3))
    right = ((rx > lx) == (hand == "right")) == (off > 0)
    side = F.when(sure >= least, F.when(right & (off != 0), "forehand").otherwise("backhand")).otherwise("unknown")
    served = serve & (side == "unknown") & hand.isin("left", "right")
    sure = F.coalesce(sure, F.lit(0.0))
    return F.struct(F.when(served, "forehand").otherwise(side).alias("side"), F.when(served, F.greatest(sure, F.lit(0.6))).otherwise(sure).alias("confidence"))


def nearest_net(*spots: tuple[Column, Column]) -> Column:
    """The spot (away, place, x, y) nearest the net (ties in their order), null if none is known."""
    options = F.array(*[F.struct(F.abs(y - NET).alias("away"), F.lit(i).alias("place"), x.alias("x"), y.alias("y")) for i, (x, y) in enumerate(spots)])
    return F.array_min(F.filter(options, lambda s: s["away"].isNotNull()))


def front_feet(contacts: DataFrame, poses: DataFrame, court: DataFrame, floor: float = 0.3) -> DataFrame:
    """Court point nearest the net among the foot of the box and the ankles that are seen (ties in that order)."""
    # Contacts go to their frame and track first, so that distinct rows need no move of their own.
    spots = contacts.select("clip_id", "frame", "track_id", "court_x_ft", "court_y_ft").repartition("clip_id", "frame", "track_id").distinct()
    joined = spots.join(court, "clip_id").join(poses.drop("court_y_ft"), ["clip_id", "frame", "track_id"], "left")
    best = nearest_net((F.col("court_x_ft"), F.col("court_y_ft")), *(project(*point(a, floor)) for a in ("la", "ra")))
    return joined.withColumn("best", best).select("clip_id", "frame", "track_id", F.col("best.x").alias("front_x"), F.col("best.y").alias("front_y"))


def scenes(shots: DataFrame, contacts: DataFrame, poses: DataFrame, court: DataFrame, foot_floor: float = 0.3, body_floor: float = 0.5) -> DataFrame:
    """Shots with their clip's court and what stands on their frame: the hitter's contact and height of contact, front feet of the
    hitter (front_x, front_y; standing: whether a contact shows the hitter) and of ``next_track`` (receiver_y).

    Shots, contacts and poses go to their frame once; tracks are compared inside it. Rows multiply as left joins by clip, frame and track would."""
    keys = ["clip_id", "frame"]
    people = contacts.select(*keys, F.struct("track_id", "court_x_ft", "court_y_ft").alias("s"), F.when(F.col("part") == "hitter", F.struct("track_id", "impact_y", "speed_pre", "speed_post", "court_y_ft")).alias("h"))
    people = people.repartition(*keys).groupBy(*keys).agg(F.collect_set("s").alias("spots_"), F.collect_list("h").alias("hits_"))
    ankles = [c.alias(n) for foot in ("la", "ra") for c, n in zip(point(foot, foot_floor), (f"{foot}x", f"{foot}y"))]
    middles = [mean_of(point("l" + part, body_floor)[1], point("r" + part, body_floor)[1]).alias(name) for part, name in (("s", "shoulders"), ("h", "hips"))]
    bodies = poses.select(*keys, F.struct("track_id", *ankles, *middles).alias("b")).repartition(*keys).groupBy(*keys).agg(F.collect_list("b").alias("bodies_"))
    rows = shots.join(people, keys, "left").join(bodies, keys, "left").join(court, "clip_id")
    of = lambda entries, track: F.filter(entries, lambda e: e["track_id"] == F.col(track))
    rows = rows.withColumn("hit_", F.explode_outer(of("hits_", "track_id"))).withColumn("body_", F.explode_outer(of("bodies_", "track_id")))
    for track, name in (("track_id", "front_"), ("next_track", "receiver_")):
        rows = rows.withColumn("spot_", F.explode_outer(of("spots_", track))).withColumn("pose_", F.explode_outer(F.when(F.col("spot_").isNotNull(), of("bodies_", track))))
        feet = [project(F.col(f"pose_.{foot}x"), F.col(f"pose_.{foot}y")) for foot in ("la", "ra")]
        rows = rows.withColumns({name: nearest_net((F.col("spot_.court_x_ft"), F.col("spot_.court_y_ft")), *feet), "standing": F.col("spot_").isNotNull() if name == "front_" else F.col("standing")})
    height = height_among(F.col("hit_.impact_y"), F.col("body_.shoulders"), F.col("body_.hips"))
    keep = [c for c in rows.columns if not c.endswith("_")]
    return rows.select(*keep, "hit_.impact_y", "hit_.speed_pre", "hit_.speed_post", "hit_.court_y_ft", height.alias("height"), F.col("front_.x").alias("front_x"), F.col("front_.y").alias("front_y"), F.col("receiver_.y").alias("receiver_y"))


def body_measures(poses: DataFrame, contacts: DataFrame, shots: DataFrame, roles: DataFrame, roster: DataFrame, court: DataFrame) -> DataFrame:
    """Knee angle, contact front, contact height and stroke of every shot whose hitter has a pose."""
    rows = (contacts.filter("part = 'hitter'").select("clip_id", "frame", "track_id", "shot_id", "impact_x", "impact_y").join(poses, ["clip_id", "frame", "track_id"])
            .join(shots.select("clip_id", "shot_id", "is_serve"), ["clip_id", "shot_id"]).join(court, "clip_id").join(roles, ["clip_id", "track_id"], "left").join(roster, "role", "left"))
    hand = F.col("hand")
    stroke = stroke_side(F.col("impact_x"), hand, F.col("is_serve"))
    return rows.withColumn("stroke", stroke).select("clip_id", "shot_id", knee_angle().alias("knee_deg"), F.round(contact_front(hand, F.col("court_y_ft")), 6).alias("front"), contact_height(F.col("impact_y")).alias("height"),
                                                    F.col("stroke.side").alias("stroke_side"), F.round(F.col("stroke.confidence"), 3).alias("stroke_confidence"))


def pose_scope(contacts: DataFrame, roles: DataFrame) -> DataFrame:
    """Rows to pose with the reason: the user's, then those of the other named roles; noise and unassigned tracks go."""
    named = contacts.join(roles, ["clip_id", "track_id"])
    reason = F.when(F.col("is_user"), "user").when(F.col("role").isin("user", "partner", "opp_a", "opp_b"), F.col("role"))
    return named.withColumn("reason", reason).filter("reason is not null").groupBy("clip_id", "reason").agg(F.count("*").alias("rows_to_pose"), F.countDistinct("track_id").alias("tracks"))


def pose_rate(contacts: DataFrame, poses: DataFrame, least: float = 0.5) -> DataFrame:
    """Share of a track's rows with a pose; the user's rate warns below ``least``."""
    have = poses.select("clip_id", "frame", "track_id", F.lit(1).alias("posed"))
    rows = contacts.filter("part = 'hitter'").join(have, ["clip_id", "frame", "track_id"], "left").groupBy("clip_id", "track_id")
    rate = F.avg(F.coalesce(F.col("posed"), F.lit(0)))
    return rows.agg(F.count("*").alias("n_rows"), rate.alias("rate"), F.max("is_user").alias("is_user"), (F.max("is_user") & (rate < least)).alias("warn"))


def ready_position(poses: DataFrame, roles: DataFrame, shots: DataFrame, half: int = 2, per_zone: int = 20, total: int = 30, floor: float = 0.3) -> DataFrame:
    """Median height of the hands between hips (0) and shoulders (1) by role and zone, away from the role's own swings.

    Zones with fewer than ``per_zone`` rows have no median; roles with fewer than ``total`` rows have no trend.
    Rows without a measure are left to the aggregates, as a filter on so nested an expression costs the optimizer minutes.
    """
    high = mean_of(*(point(p, floor)[1] for p in ("lw", "rw")))
    hips, shoulders = mean_of(*(point(p, floor)[1] for p in ("lh", "rh"))), mean_of(*(point(p, floor)[1] for p in ("ls", "rs")))
    swings = shots.filter("not is_serve").select("clip_id", "track_id", F.explode(F.sequence(F.col("frame") - half, F.col("frame") + half)).alias("frame")).distinct()
    rows = (poses.join(swings, ["clip_id", "track_id", "frame"], "left_anti").join(roles.filter("role <> 'noise'"), ["clip_id", "track_id"])
            .select("role", zone(F.col("court_y_ft")).alias("zone"), F.try_divide(hips - high, F.when(hips > shoulders, hips - shoulders)).alias("ready")))
    zones = rows.groupBy("role", "zone").agg(F.count("ready").alias("n"), F.percentile("ready", F.lit(0.5)).alias("median"))
    per = [F.max(F.when((F.col("zone") == z) & (F.col("n") >= per_zone), F.col("median"))).alias(z) for z in ("kitchen", "transition", "baseline")]
    return zones.groupBy("role").agg(F.sum("n").alias("n_rows"), *per).withColumn("rises_at_net", F.when(F.col("n_rows") >= total, F.col("kitchen") > F.col("baseline") + 0.05))
