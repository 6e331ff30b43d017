"""Many clips as one match: offsets from all streams, streams with renumbered ids, and whether all references still hold.

``members(collection_id, clip_id)`` says which clips make a collection, in the order of clip_id. Streams are those of the
single clips; every id and every reference to one is shifted by its member's offsets, by joins with the table of members."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scoring import project_poses

IDS = ("shots", "rallies", "bounces", "tracks", "frames")


def all_offsets(members: DataFrame, shots: DataFrame, rallies: DataFrame, bounces: DataFrame, players: DataFrame, roles: DataFrame, court: DataFrame) -> DataFrame:
    """Of each member: its place in the collection (video_id), its span in seconds, and what comes before it: the largest ids and
    frames of all its streams, the number of its rallies and the spans."""
    most = lambda df, c, name: df.groupBy("clip_id").agg((F.max(c) + 1).cast("long").alias(name))
    frames = shots.select("clip_id", "frame").unionByName(bounces.select("clip_id", "frame")).unionByName(players.select("clip_id", "frame"))
    events = shots.select("clip_id", "frame").unionByName(bounces.select("clip_id", "frame")).unionByName(rallies.select("clip_id", F.col("end_frame").alias("frame")))
    span = events.groupBy("clip_id").agg((F.max("frame") - F.min("frame")).alias("span")).join(court.select("clip_id", "fps"), "clip_id").select("clip_id", (F.col("span") / F.col("fps")).alias("span_sec"))
    rows = members.select("collection_id", "clip_id")
    for part in (most(shots, "shot_id", "shots"), rallies.groupBy("clip_id").agg(F.count("*").alias("rallies")), most(bounces, "bounce_id", "bounces"), most(roles, "track_id", "tracks"), most(frames, "frame", "frames"), span):
        rows = rows.join(part, "clip_id", "left")
    w = Window.partitionBy("collection_id").orderBy("clip_id")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda c, zero: F.coalesce(F.sum(F.coalesce(c, zero)).over(before), zero)
    return rows.select("collection_id", "clip_id", (F.row_number().over(w) - 1).cast("long").alias("video_id"), *[upto(k, F.lit(0).cast("long")).alias(f"{k}_before") for k in IDS],
                       F.coalesce("span_sec", F.lit(0.0)).alias("span_sec"), upto("span_sec", F.lit(0.0)).alias("sec_before"))


def _placed(df: DataFrame, offsets: DataFrame, keep: list[str], **new) -> DataFrame:
    """``df`` with collection_id and video_id, the columns ``keep`` and ``new`` ones."""
    return df.join(offsets, "clip_id").select("collection_id", "video_id", *keep, *[c.alias(n) for n, c in new.items()])


def _up(c: str, kind: str):
    return (F.col(c) + F.col(f"{kind}_before")).cast("long")


def union_all(offsets: DataFrame, shots: DataFrame, rallies: DataFrame, bounces: DataFrame, players: DataFrame, roles: DataFrame, court: DataFrame, poses: DataFrame | None = None, pool: bool = True) -> dict[str, DataFrame]:
    """The streams of each collection: shots, rallies (shot_ids rewritten), bounces (between rewritten), players, roles and poses.

    Frames of the member stay as video_frame. With ``pool`` the two opponents are one, since they differ from clip to clip.
    Poses are placed by their own clip's court first: pixels mean nothing beside another clip's."""
    of_frame = {"video_frame": F.col("frame"), "frame": _up("frame", "frames")}
    at = lambda c: F.round(F.col(c) / F.col("fps") + F.col("sec_before"), 4)
    fps = offsets.join(court.select("clip_id", "fps"), "clip_id")
    ids = lambda c: F.transform(c, lambda x: (x + F.col("shots_before")).cast("long"))
    out = {
        "shots": _placed(shots, fps, [c for c in ("role", "shot_type", "hitter_side", "is_serve") if c in shots.columns], shot_id=_up("shot_id", "shots"), track_id=_up("track_id", "tracks"), t_sec=at("frame"), **of_frame),
        "rallies": _placed(rallies, fps, ["n_shots", "end_reason"], rally_id=_up("rally_id", "rallies"), shot_ids=ids("shot_ids"), serve_shot_id=_up("serve_shot_id", "shots"), server=_up("server", "tracks"), start_frame=_up("start_frame", "frames"), end_frame=_up("end_frame", "frames"), start_t_sec=at("start_frame"), end_t_sec=at("end_frame")),
        "bounces": _placed(bounces, fps, [], bounce_id=_up("bounce_id", "bounces"), between=ids("between"), t_sec=at("frame"), **of_frame),
        "players": _placed(players, fps, ["court_x_ft", "court_y_ft"], track_id=_up("track_id", "tracks"), t_sec=at("frame"), **of_frame),
        "roles": _placed(roles, fps, ["role_confidence"], track_id=_up("track_id", "tracks"), role=F.when(F.lit(pool) & (F.col("role") == "opp_b"), "opp_a").otherwise(F.col("role")))}
    if poses is not None:
        out["poses"] = _placed(project_poses(poses, court), fps, ["front_x", "front_y"], track_id=_up("track_id", "tracks"), **of_frame)
    return out


def check_references(union: dict[str, DataFrame]) -> DataFrame:
    """Per collection: references from rallies and from bounces to shots, how many lead nowhere, frames that several shots or
    several bounces share, and tracks without a role."""
    key = ["collection_id"]
    known = union["shots"].select(*key, F.col("shot_id").alias("ref")).distinct().withColumn("known", F.lit(True))
    refs = union["rallies"].select(*key, F.lit("rallies").alias("of"), F.explode("shot_ids").alias("ref")).unionByName(union["bounces"].select(*key, F.lit("bounces").alias("of"), F.explode("between").alias("ref")).filter("ref is not null"))
    refs = refs.join(known, [*key, "ref"], "left").groupBy(*key).agg(*[F.count_if(F.col("of") == k).alias(f"{k}_refs") for k in ("rallies", "bounces")], *[F.count_if((F.col("of") == k) & F.col("known").isNull()).alias(f"{k}_dangling") for k in ("rallies", "bounces")])
    frames = union["shots"].select(*key, F.lit("shots").alias("of"), "frame").unionByName(union["bounces"].select(*key, F.lit("bounces").alias("of"), "frame")).groupBy(*key, "of", "frame").agg(F.count("*").alias("n"))
    frames = frames.groupBy(*key).agg(F.count_if(F.col("n") > 1).alias("shared_frames"))
    tracks = union["players"].select(*key, "track_id").distinct().join(union["roles"].select(*key, "track_id").distinct().withColumn("has", F.lit(True)), [*key, "track_id"], "left").groupBy(*key).agg(F.count_if(F.col("has").isNull()).alias("tracks_without_role"))
    out = refs.join(frames, key, "full").join(tracks, key, "full")
    return out.na.fill(0, [c for c in out.columns if c != "collection_id"])


def provenance(offsets: DataFrame, shots: DataFrame, rallies: DataFrame, bounces: DataFrame, court: DataFrame) -> DataFrame:
    """Where a collection comes from: a row per member with its counts, span, frame rate and kind of ball."""
    n = lambda df, name: df.groupBy("clip_id").agg(F.count("*").alias(name))
    rows = offsets.select("collection_id", "video_id", "clip_id", F.round("span_sec", 3).alias("span_sec"))
    for part in (n(shots, "n_shots"), n(rallies, "n_rallies"), n(bounces, "n_bounces"), court.select("clip_id", "fps", F.when(F.col("real"), "real").otherwise("synthetic").alias("ball_source"))):
        rows = rows.join(part, "clip_id", "left")
    return rows.na.fill(0, ["n_shots", "n_rallies", "n_bounces"])


def reliability(members: DataFrame, court: DataFrame, gated: DataFrame) -> DataFrame:
    """Per collection the worst of its members: synthetic if any ball isn't real, and every metric that is gated in any of them.
    ``gated(clip_id, metric)``."""
    real = members.join(court.select("clip_id", "real"), "clip_id", "left").groupBy("collection_id").agg(F.count("*").alias("members"), (~F.bool_and(F.coalesce("real", F.lit(False)))).alias("synthetic"))
    names = members.join(gated, "clip_id").groupBy("collection_id").agg(F.array_sort(F.collect_set("metric")).alias("gated"))
    return real.join(names, "collection_id", "left").withColumn("gated", F.coalesce("gated", F.array().cast("array<string>")))
