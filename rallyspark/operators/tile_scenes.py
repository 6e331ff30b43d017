"""Shots meet contacts, poses and bounces of their frames, and the shots and bounces before and after them, in one ordered pass per
tile of a clip.

Every table goes to its tile once, as narrow rows of one table, and is sorted there once. Rows at a tile's ends (a few per tile) look
further over one row per tile, so that neither a clip's length nor its pauses cost a task's memory. What is asked is worked out in
the pass and written, with the rows at the ends beside it; only those are finished after."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import NET, project
from ..sources.readers import written
from .poses import height_among, mean_of, point
from .tiles import TILE

BOUNCE, SHOT, OTHER = 0, 1, 2
#: what rows show to others: shots to the one before and after, shots and bounces with a place, frames of bounces, hitters whom a contact shows
AHEAD = f"CASE WHEN kind_ = {SHOT} THEN struct(frame, id_, shot_.track_id) END"
BEHIND = f"CASE WHEN kind_ = {SHOT} THEN struct(frame, id_, shot_.is_serve, shot_.hitter_side) END"
EVENT_KIND = f"CASE WHEN kind_ = {SHOT} OR bounce_.y IS NOT NULL THEN kind_ END"
EVENT = f"CASE WHEN {EVENT_KIND} IS NOT NULL THEN struct(frame, kind_, id_, bounce_.x, bounce_.y) END"
FALL = f"CASE WHEN kind_ = {BOUNCE} THEN frame END"
_ORDER = "OVER (PARTITION BY clip_id, tile_ ORDER BY frame, kind_, id_)"


def _rows(rows: DataFrame, kind: int, number: Column, name: str, value: Column) -> DataFrame:
    tile = F.col("tile_") if "tile_" in rows.columns else _tile(F.col("frame"))
    return rows.select("clip_id", tile.alias("tile_"), "frame", F.lit(kind).alias("kind_"), number.cast("long").alias("id_"), value.alias(name))


def _tile(frame: Column) -> Column:
    """The frame's tile; shots without a frame come before all others."""
    return F.coalesce(F.floor(frame.cast("long") / TILE), F.lit(-(2**62)))


def events(shots: DataFrame, contacts: DataFrame, poses: DataFrame, bounces: DataFrame, court: DataFrame, hits: bool, flights: DataFrame | None, foot_floor: float = 0.3, body_floor: float = 0.5) -> DataFrame:
    """The tables as rows of one: clip_id, frame, kind_ (bounces come before shots), id_, and a struct that is set for its kind only.

    Of a pose only the ankle nearest the net and, with ``hits``, shoulders and hips go along; ``flights(clip_id, frame, shot_id, arc, bounced)`` lie on their shot's frame."""
    none, c = F.lit(None), F.col
    known = lambda rows: rows.filter("frame is not null")
    hit = [(c("part") == "hitter").alias("hit"), "impact_y", "speed_pre", "speed_post"] if hits else []
    middles = [mean_of(point("l" + part, body_floor)[1], point("r" + part, body_floor)[1]).alias(name) for part, name in (("s", "shoulders"), ("h", "hips"))] if hits else []
    # Step by step, as an expression named twice is worked out twice.
    posed = known(poses.drop("court_y_ft")).join(F.broadcast(court), "clip_id")  # a row per clip
    posed = posed.withColumns({f"{foot}{at}_": v for foot in ("la", "ra") for at, v in zip("xy", point(foot, foot_floor))})
    posed = posed.withColumns({f"{foot}{at}_": v for foot in ("la", "ra") for at, v in zip("xy", project(c(f"{foot}x_"), c(f"{foot}y_")))})
    posed = posed.withColumn("left_", c("lay_").isNotNull() & (c("ray_").isNull() | (F.abs(c("lay_") - NET) <= F.abs(c("ray_") - NET))))
    ankle = [F.when(c("left_"), c(f"la{at}_")).otherwise(c(f"ra{at}_")).alias(at) for at in "xy"]
    parts = [_rows(shots, SHOT, c("shot_id"), "shot_", F.struct("track_id", "is_serve", "hitter_side")),
             _rows(known(bounces), BOUNCE, c("bounce_id"), "bounce_", F.struct(c("court_x_ft").alias("x"), c("court_y_ft").alias("y"))),
             _rows(known(contacts), OTHER, none, "person_", F.struct("track_id", c("court_x_ft").alias("x"), c("court_y_ft").alias("y"), *hit)),
             _rows(posed, OTHER, none, "body_", F.struct("track_id", *ankle, *middles))]
    if flights is not None:
        parts.append(_rows(flights, OTHER, none, "flight_", F.struct("shot_id", "arc", "bounced")))
    # Tables that come by tile stay where they are; the others go to them.
    by_tile = ["tile_" in rows.columns for rows in (shots, bounces, contacts, poses)] + [False]
    buckets = shots.schema["tile_"].metadata.get("buckets") if by_tile[0] else None
    if buckets:
        parts = [part if there else part.repartition(buckets, "clip_id", "tile_") for part, there in zip(parts, by_tile)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out if buckets else out.repartition("clip_id", "tile_")


def neighbours(rows: DataFrame) -> DataFrame:
    """Shots of a tile, and bounces at its ends, with the lists of what stands on their frame and, from inside the tile: later_ and earlier_ shot, the event
    (shot or bounce with a place) after as after_, whether there is one before (follows_), and the last frame before with a bounce, fell_."""
    lists = [name for name in ("person_", "body_", "flight_") if name in rows.columns]
    frame = Window.partitionBy("clip_id", "tile_", "frame").orderBy("kind_", "id_").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = rows.withColumns({f"{name[:-1]}s_": F.collect_list(name).over(frame) for name in lists}).filter(F.col("kind_") != OTHER).drop(*lists)
    shot, bounce = F.col("kind_") == SHOT, F.col("kind_") == BOUNCE
    looks = {"later_": f"lead({AHEAD})", "earlier_": f"lag({BEHIND})", "after_": f"lead({EVENT})"} | {"follows_": f"lag({EVENT_KIND})", "falls_": f"lead({FALL})"}
    earlier = Window.partitionBy("clip_id", "tile_").orderBy("frame").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({name: F.expr(f"{look} IGNORE NULLS {_ORDER}") for name, look in looks.items()} | {"fell_": F.max(F.expr(FALL)).over(earlier)})
    rows = rows.withColumns({name: F.col(name).isNotNull() for name in ("follows_", "falls_")})
    ends = bounce & ((F.col("bounce_.y").isNotNull() & ~F.col("follows_")) | ~F.col("falls_"))
    return rows.filter(shot | ends)


def _of(entries: str | Column, track: Column) -> Column:
    return F.filter(entries, lambda e: e["track_id"] == track)


def _some(entries: Column) -> Column:
    """The entries, or one null if there are none, as in an outer join."""
    return F.when(F.size(entries) > 0, entries).otherwise(F.array(F.lit(None)))


def _feet(people: Column, bodies: Column) -> Column:
    """Front feet (x, y, last: whether it is the list's last) by a track's contacts and poses on a frame: one for each pair of a spot and a pose, none without a contact."""
    off = lambda at: F.abs(at["y"] - NET)

    def front(s: Column, p: Column) -> Column:
        box = s["y"].isNotNull() & (p["y"].isNull() | (off(s) <= off(p)))  # ties: the box
        return F.struct(*[F.when(box, s[at]).otherwise(p[at]).alias(at) for at in "xy"], F.lit(True).alias("last"))

    spots = F.array_distinct(F.transform(people, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y"))))
    pairs = F.flatten(F.transform(spots, lambda s: F.transform(_some(bodies), lambda p: front(s, p))))
    pairs = F.transform(pairs, lambda f, i: F.struct(f["x"].alias("x"), f["y"].alias("y"), (i == F.size(pairs) - 1).alias("last")))
    return F.when((F.size(people) == 1) & (F.size(bodies) <= 1), F.array(front(people[0], F.get(bodies, F.lit(0))))).otherwise(pairs)


def _hitters(rows: DataFrame) -> DataFrame:
    track = F.col("shot_.track_id")
    return rows.withColumns({"people_": _of("persons_", track), "poses_": _of("bodys_", track)})


def standing(rows: DataFrame) -> DataFrame:
    """Adds the hitter's feet_ and, where a contact shows the hitter, the next such shot of the tile as contact_, and whether there is one before (stood_)."""
    rows = _hitters(rows).withColumn("feet_", _feet(F.col("people_"), F.col("poses_"))).drop("people_", "poses_")
    foot = F.get("feet_", F.lit(0))
    rows = rows.withColumn("stand_", F.when((F.col("kind_") == SHOT) & (F.size("feet_") > 0), F.struct("frame", "id_", "shot_.is_serve", foot["x"].alias("x"), foot["y"].alias("y"))))
    return rows.withColumns({"contact_": F.expr(f"lead(stand_) IGNORE NULLS {_ORDER}"), "stood_": F.expr(f"lag(stand_) IGNORE NULLS {_ORDER}").isNotNull()})


def _settle(ends: DataFrame) -> DataFrame:
    """Shots at their tile's ends with what they miss from the tiles before and after, by one row per tile."""
    c = F.col
    shot, stands = c("kind_") == SHOT, "stand_" in ends.columns
    of = {"first_": F.min(F.when(c("earlier_").isNull(), F.expr(AHEAD))), "last_": F.max(F.when(c("later_").isNull(), F.expr(BEHIND))), "event_": F.min(F.when(~c("follows_"), F.expr(EVENT))), "fall_": F.max(F.expr(FALL))}
    of |= {"stand_": F.min(F.when(~c("stood_"), c("stand_")))} if stands else {}
    clip = Window.partitionBy("clip_id").orderBy("tile_")
    look = lambda way, value: F.expr(f"{way}({value}) IGNORE NULLS OVER (PARTITION BY clip_id ORDER BY tile_)")
    ways = {"later_": look("lead", "first_"), "earlier_": look("lag", "last_"), "after_": look("lead", "event_"), "fell_": F.max("fall_").over(clip.rowsBetween(Window.unboundedPreceding, -1))} | ({"contact_": look("lead", "stand_")} if stands else {})
    tiles = ends.groupBy("clip_id", "tile_").agg(*[v.alias(k) for k, v in of.items()]).select("clip_id", "tile_", *[v.alias(f"{k}far_") for k, v in ways.items()])
    rows = ends.filter(shot).join(tiles, ["clip_id", "tile_"])
    return rows.withColumns({k: F.coalesce(k, f"{k}far_") for k in ways}).drop(*[f"{k}far_" for k in ways])


def scenes_by_tile(shots: DataFrame, contacts: DataFrame, poses: DataFrame, bounces: DataFrame, court: DataFrame, scene: Callable[[DataFrame], DataFrame], columns: list[Column], where: Column | None = None,
                   hits: bool = True, speeds: bool = False, flights: DataFrame | None = None) -> DataFrame:
    """``columns`` of what ``scene`` adds to the shots, written once. Its rows have clip_id, frame, shot_id, track_id, is_serve, hitter_side, later_ and earlier_ shot, land_frame, land_x, land_y
    (the first bounce with a place after the shot and up to the next), fell_, the clip's court, the lists persons_ and bodys_ (flights_) and, with ``speeds``, feet_ and contact_; it may multiply them."""
    c, shot, number = F.col, F.col("kind_") == SHOT, shots.schema["shot_id"].dataType
    rows = neighbours(events(shots, contacts, poses, bounces, court, hits, flights))
    end = ~shot | c("later_").isNull() | c("earlier_").isNull()
    if speeds:
        rows = standing(rows)
        end = end | (c("stand_").isNotNull() & (c("contact_").isNull() | ~c("stood_")))

    def made(rows: DataFrame) -> DataFrame:
        land = F.when(c("after_.kind_") == BOUNCE, c("after_"))
        of_shot = {"shot_id": c("id_").cast(number)} | {k: c(f"shot_.{k}") for k in ("track_id", "is_serve", "hitter_side")}
        return scene(rows.withColumns(of_shot | {"land_frame": land["frame"], "land_x": land["x"], "land_y": land["y"]}).join(F.broadcast(court), "clip_id"))

    # Rows at the ends wait, without lists, so that they stay one row each.
    lists = [n for n in rows.columns if n in ("persons_", "bodys_", "feet_", "flights_")]
    rows = rows.withColumns({"at_end_": end, "end_": F.when(end, F.struct(*rows.columns))}).withColumns({n: F.when(~end, c(n)).otherwise(F.array()) for n in lists})
    first = made(rows)
    first = written((first if where is None else first.filter(c("at_end_") | where)).select(*columns, "at_end_", "end_"))
    last = made(_settle(first.filter("at_end_").select("end_.*")))
    last = (last if where is None else last.filter(where)).select(*columns)
    return first.filter("not at_end_").select(*last.columns).unionByName(last)


def scene(rows: DataFrame) -> DataFrame:
    """Adds to shots of a tile what context and type rest on: is_return, the hitter's contact and height of contact, front feet of hitter and receiver."""
    c, ahead = F.col, F.col("later_.track_id")
    rows = _hitters(rows).withColumns({"people2_": _of("persons_", ahead), "poses2_": _of("bodys_", ahead)})
    rows = rows.withColumns({"hits_": F.filter("people_", lambda p: p["hit"]), "feet2_": _feet(c("people2_"), c("poses2_"))} | ({} if "feet_" in rows.columns else {"feet_": _feet(c("people_"), c("poses_"))}))
    sides = {"hit_": "hits_", "body_": "poses_", "receiver_": "feet2_", "front_": "feet_"}

    def crossed(left: list[str], *got: Column) -> Column:
        """The left joins with the lists, one after another."""
        here = lambda e: F.struct(*[v.alias(k) for k, v in zip(sides, (*got, e))])
        if len(left) == 1:
            return F.transform(_some(c(left[0])), here)
        return F.flatten(F.transform(_some(c(left[0])), lambda e: crossed(left[1:], *got, e)))

    single = reduce(Column.__and__, [F.size(v) <= 1 for v in sides.values()])  # as a rule
    scenes = F.when(single, F.array(F.struct(*[F.get(c(v), F.lit(0)).alias(k) for k, v in sides.items()]))).otherwise(crossed(list(sides.values())))
    rows = rows.withColumn("scene_", F.explode(scenes)).withColumns({k: c(f"scene_.{k}") for k in sides})
    back = F.coalesce(c("earlier_.is_serve") & (c("earlier_.hitter_side") != c("hitter_side")), F.lit(False))
    return rows.withColumns({"is_return": back, "front_x": c("front_.x"), "front_y": c("front_.y"), "receiver_y": c("receiver_.y"), "court_y_ft": c("hit_.y"), "speed_pre": c("hit_.speed_pre"), "speed_post": c("hit_.speed_post"),
                             "height": height_among(c("hit_.impact_y"), c("body_.shoulders"), c("body_.hips"))})
