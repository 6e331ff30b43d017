"""Many clips as one: offsets, unions, admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def member_offsets(shots: DataFrame, rallies: DataFrame, group: int = 8) -> DataFrame:
    """Running id and frame offsets of clips inside a collection (clip_id modulo ``group``), in clip order."""
    per = shots.groupBy("clip_id").agg((F.max("shot_id") + 1).alias("n_shots"), (F.max("frame") + 1).alias("n_frames"), (F.max("track_id") + 1).alias("n_tracks"))
    per = per.join(rallies.groupBy("clip_id").agg(F.count("*").alias("n_rallies")), "clip_id").withColumn("collection_id", F.col("clip_id") % group)
    w = Window.partitionBy("collection_id").orderBy("clip_id").rowsBetween(Window.unboundedPreceding, -1)
    return per.select("collection_id", "clip_id", *[F.coalesce(F.sum(f"n_{k}").over(w), F.lit(0)).alias(f"{k}_offset") for k in ("shots", "frames", "tracks", "rallies")])


def union_streams(shots: DataFrame, offsets: DataFrame) -> DataFrame:
    """Shots of all members with shifted ids and frames; the member's own frame is kept."""
    return shots.join(offsets, "clip_id").select("collection_id", F.col("clip_id").alias("video_id"), F.col("frame").alias("video_frame"), (F.col("shot_id") + F.col("shots_offset")).alias("shot_id"),
                                                 (F.col("frame") + F.col("frames_offset")).alias("frame"), (F.col("track_id") + F.col("tracks_offset")).alias("track_id"), "shot_type")


def pool_roles(roles: DataFrame) -> DataFrame:
    return roles.withColumn("pooled", F.when(F.col("role") == "opp_b", "opp_a").otherwise(F.col("role"))).groupBy("clip_id", "pooled").agg(F.count("*").alias("tracks"), F.avg("role_confidence").alias("confidence"))


def check_union(shots: DataFrame, bounces: DataFrame, roles: DataFrame) -> DataFrame:
    """Per clip: bounces without their shot, tracks without a role, repeated shot ids."""
    dangling = bounces.join(shots.select("clip_id", F.col("shot_id").alias("made_by")), ["clip_id", "made_by"], "left_anti").select("clip_id", F.lit("dangling").alias("fault"))
    no_role = shots.select("clip_id", "track_id").distinct().join(roles.filter("role <> 'noise'"), ["clip_id", "track_id"], "left_anti").select("clip_id", F.lit("no_role").alias("fault"))
    twice = shots.groupBy("clip_id", "shot_id").agg(F.count("*").alias("n")).filter("n > 1").select("clip_id", F.lit("repeated").alias("fault"))
    return dangling.unionByName(no_role).unionByName(twice).groupBy("clip_id", "fault").agg(F.count("*").alias("n"))


def worst_case_reliability(members: DataFrame) -> DataFrame:
    return members.groupBy("collection_id").agg((~F.bool_and("supported")).alias("any_unsupported"), F.count("*").alias("members"), F.array_sort(F.collect_set("content_hash")).alias("hashes"))


def admit_members(members: DataFrame) -> DataFrame:
    """Admission per collection in capture order: unsupported venues and repeated content are refused."""
    w = Window.partitionBy("collection_id", "content_hash", "supported").orderBy("captured_order", "member_id")
    reason = F.when(~F.col("supported"), "unsupported_venue").when(F.col("place") > 1, "same_content").otherwise("admitted")
    return members.withColumn("place", F.row_number().over(w)).select("collection_id", "member_id", reason.alias("decision"))


def version_footnote(members: DataFrame) -> DataFrame:
    return members.groupBy("collection_id").agg(F.count_distinct("pipeline_version").alias("versions")).withColumn("mixed", F.col("versions") > 1)
