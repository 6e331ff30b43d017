"""Rallies from shots, and event views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import in_receivers_kitchen, side_of_net
from .ball import KNOWN
from .shots import last_shot


def CLIP():  # noqa: N802
    return Window.partitionBy("clip_id")


def ORDER():  # noqa: N802
    return CLIP().orderBy("frame", "shot_id")


#: Why a rally ends.
REASONS = ("serve-fault", "double-bounce", "net-or-short", "ball-out", "ball-not-returned", "ball-off-frame", "unknown")
#: Frames at 30 a second within which the next serve shows that a lone serve was a fault; and what a rally on a
#: real ball has at least, in shots or in seconds.
FAULT_FRAMES, LEAST_SHOTS, LEAST_S = 60, 3, 2.0


def segment_rallies(shots: DataFrame, court: DataFrame | None = None) -> DataFrame:
    """Every serve starts a rally; shots before a clip's first serve are dropped.

    On clips whose ball is real (``court(clip_id, real)``) the first shot starts a rally too, since its serve may have been
    missed, and shots between points (is_between_point) belong to none."""
    if court is None:
        n = F.sum(F.col("is_serve").cast("int")).over(ORDER().rowsBetween(Window.unboundedPreceding, 0))
        return shots.withColumn("rally_id", n - 1).filter("rally_id >= 0")
    rows = shots.join(court.select("clip_id", "real"), "clip_id").filter("not (real and coalesce(is_between_point, false))")
    starts = F.coalesce("is_serve", F.lit(False)) | (F.col("real") & (F.row_number().over(ORDER()) == 1))
    n = F.sum(starts.cast("int")).over(ORDER().rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("rally_id", n - 1).filter("rally_id >= 0")


def apply_rally_ends(shots: DataFrame, ends: DataFrame, within: int = 900) -> DataFrame:
    """Marks shots strictly after an end, within ``within`` frames, with no serve since that end, as between points."""
    marks = shots.select("clip_id", "frame", "shot_id", "is_serve", F.lit(False).alias("is_end")).unionByName(
        ends.select("clip_id", "frame", F.lit(None).cast("long").alias("shot_id"), F.lit(False).alias("is_serve"), F.lit(True).alias("is_end")))
    by = CLIP().orderBy("frame")
    end = F.max(F.when(F.col("is_end"), F.col("frame"))).over(by.rangeBetween(Window.unboundedPreceding, -1))
    serve = F.max(F.when(F.col("is_serve"), F.col("frame"))).over(by.rangeBetween(Window.unboundedPreceding, 0))
    out = marks.withColumn("end", end).withColumn("serve", serve).filter("not is_end")
    return out.select("clip_id", "shot_id", F.coalesce((F.col("frame") - F.col("end") <= within) & (F.col("serve").isNull() | (F.col("serve") <= F.col("end"))), F.lit(False)).alias("between_points"))


def drop_micro(rallies: DataFrame, shots: int = 3, span: int = 120) -> DataFrame:
    return rallies.filter(~((F.col("n_shots") > 1) & (F.col("n_shots") < shots) & (F.col("end_frame") - F.col("start_frame") < span)))


def ends_of_rallies(spans: DataFrame, bounces: DataFrame) -> DataFrame:
    """``spans`` with reason, confidence, ending_bounce_id, ending_frame and signals, by the bounces after a rally's last shot.

    ``spans`` has clip_id, n_shots, last_shot, last_frame, hitter_side (of the last shot), server_side, next_start (of the
    clip's next rally), fault_frames and real; ``bounces`` has clip_id, prev_shot, bounce_id, frame, is_in, out_side and y. The
    first rule that fits decides; without any bounce a real ball leaves the reason unknown, since the bounce was missed rather."""
    at = F.struct("frame", "bounce_id", "is_in", "out_side", side_of_net(F.col("y")).alias("side"), "y")
    post = bounces.filter("prev_shot is not null").groupBy("clip_id", F.col("prev_shot").alias("last_shot")).agg(F.count("*").alias("post"), F.min(at).alias("first_"), F.max(at).alias("last_"))
    rows = spans.join(post, ["clip_id", "last_shot"], "left").withColumn("post", F.coalesce("post", F.lit(0).cast("long")))
    short = lambda which: F.coalesce(in_receivers_kitchen(F.col(f"{which}.y"), F.col("server_side")), F.lit(False))
    wait, inside = F.col("next_start") - F.col("last_frame"), F.col("last_.is_in")
    soon = F.coalesce((wait > 0) & (wait <= F.col("fault_frames")), F.lit(False))
    lone = F.struct(F.lit(REASONS[0]).alias("reason"), F.when(~F.col("first_.is_in") | short("first_"), 0.9).when(soon, 0.7).otherwise(0.5).alias("confidence"), F.col("first_").alias("b"))
    is_ = lambda k, sure, b=F.col("last_"): F.struct(F.lit(REASONS[k]).alias("reason"), F.lit(sure).alias("confidence"), b.alias("b"))
    none = F.when(F.lit(False), F.col("last_"))
    end = (F.when(F.col("n_shots") == 1, lone).when(F.col("post") >= 2, is_(1, 0.85)).when(inside & (F.col("last_.side") == F.col("hitter_side")), is_(2, 0.8)).when((F.col("post") == 1) & ~inside, is_(3, 0.85)).when(inside, is_(4, 0.75))
           .when((F.col("post") == 0) & (wait > 0) & ~F.col("real"), is_(5, 0.5, none)).otherwise(is_(6, 0.3, none)))
    signals = F.struct(F.col("post").alias("n_bounces_after_last_shot"), inside.alias("last_bounce_in_court"), F.col("last_.out_side").alias("last_bounce_out_side"), F.col("last_.side").alias("last_bounce_side"),
                       F.when(F.col("last_").isNotNull(), in_receivers_kitchen(F.col("last_.y"), F.col("server_side"))).alias("last_bounce_in_kitchen"), "hitter_side", "server_side", wait.alias("frames_to_next_serve"))
    return rows.withColumns({"end_": end, "signals": signals}).select(*spans.columns, F.col("end_.reason").alias("end_reason"), F.col("end_.confidence").alias("end_confidence"), F.col("end_.b.bounce_id").alias("ending_bounce_id"),
                                                                      F.col("end_.b.frame").alias("ending_frame"), "signals")


def rallies_of(shots: DataFrame, bounces: DataFrame, court: DataFrame) -> DataFrame:
    """Rallies of classified shots: segmented, without micro rallies (real balls only), numbered, with their ends.

    ``shots`` as in segment_rallies() with track_id, is_user and hitter_side; ``bounces`` as in ends_of_rallies(); ``court`` has
    clip_id, fps and real. The end frame is that of the last shot or of the ending bounce, whichever is later; a start without a
    serve is marked as inferred."""
    at = F.struct("frame", "shot_id", "track_id", "is_user", "hitter_side", "is_serve")
    groups = segment_rallies(shots, court).groupBy("clip_id", "rally_id").agg(F.min(at).alias("s"), F.max(at).alias("e"), F.count("*").alias("n_shots"), F.transform(F.sort_array(F.collect_list(F.struct("frame", "shot_id"))), lambda x: x["shot_id"]).alias("shot_ids"))
    groups = groups.join(court.select("clip_id", "fps", "real"), "clip_id")
    micro = F.col("real") & (F.col("n_shots") > 1) & (F.col("n_shots") < LEAST_SHOTS) & ((F.col("e.frame") - F.col("s.frame")) / F.col("fps") < LEAST_S)
    w = CLIP().orderBy("s.frame", "rally_id")
    spans = groups.filter(~micro).select("clip_id", (F.row_number().over(w) - 1).cast("long").alias("rally_id"), F.col("s.frame").alias("start_frame"), "n_shots", "shot_ids", F.col("s.shot_id").alias("serve_shot_id"), F.col("s.track_id").alias("server"),
                                         F.col("s.is_user").alias("server_is_user"), (F.col("real") & ~F.coalesce("s.is_serve", F.lit(False))).alias("serve_is_inferred"), F.col("e.shot_id").alias("last_shot"), F.col("e.frame").alias("last_frame"),
                                         F.col("e.hitter_side").alias("hitter_side"), F.col("s.hitter_side").alias("server_side"), F.lead("s.frame").over(w).alias("next_start"), F.greatest(F.lit(1), F.bround(FAULT_FRAMES * F.col("fps") / 30).cast("int")).alias("fault_frames"), "fps", "real")
    ended = ends_of_rallies(spans, bounces).withColumn("end_frame", F.greatest("last_frame", "ending_frame"))
    return ended.withColumn("seconds", F.round((F.col("end_frame") - F.col("start_frame")) / F.col("fps"), 3)).drop("last_frame", "ending_frame", "next_start", "fault_frames", "fps", "hitter_side", "server_side")


def rally_counts(rallies: DataFrame, shots: DataFrame) -> DataFrame:
    """Per clip: rallies in all and by reason, their shots and those in none, mean length and mean seconds."""
    of = rallies.groupBy("clip_id").agg(F.count("*").alias("rallies"), *[F.count_if(F.col("end_reason") == r).alias(r.replace("-", "_")) for r in REASONS], F.sum("n_shots").alias("in_rallies"), F.round(F.avg("n_shots"), 3).alias("mean_length"), F.round(F.avg("seconds"), 3).alias("mean_seconds"))
    counted = [c for c in of.columns if c != "clip_id"]
    rows = shots.groupBy("clip_id").agg(F.count("*").alias("shots")).join(of, "clip_id", "left").na.fill(0, counted)
    return rows.withColumn("unassigned", F.col("shots") - F.col("in_rallies")).drop("shots")


def rally_rows(shots: DataFrame, fps: float = 60.0) -> DataFrame:
    """One row per rally with its ordered shot ids."""
    ids = F.transform(F.sort_array(F.collect_list(F.struct("frame", "shot_id"))), lambda s: s["shot_id"])
    return shots.groupBy("clip_id", "rally_id").agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), ((F.max("frame") - F.min("frame")) / fps).alias("seconds"),
                                                    ids.alias("shot_ids"), F.min_by("track_id", F.struct("frame", "shot_id")).alias("server"), F.bool_or("is_serve").alias("served"))


def rally_stats(rallies: DataFrame) -> DataFrame:
    return rallies.groupBy("clip_id", "end_reason").agg(F.count("*").alias("rallies"), F.sum("n_shots").alias("shots"), F.avg("n_shots").alias("mean_length"), F.avg(F.col("end_frame") - F.col("start_frame")).alias("mean_frames"))


def longest_dead_run(shots: DataFrame, ball: DataFrame) -> DataFrame:
    """Longest run of unknown ball frames strictly between consecutive shots."""
    dead = last_shot(ball.filter(~KNOWN()).select("clip_id", "frame"), shots).filter("frame > at and frame < next_frame")
    island = F.col("frame") - F.row_number().over(Window.partitionBy("clip_id", "shot_id").orderBy("frame"))
    runs = dead.withColumn("island", island).groupBy("clip_id", "shot_id", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("clip_id", "shot_id").agg(F.max("n").alias("dead_frames"))


# ---- views

def timeline(rallies: DataFrame, shots: DataFrame, bounces: DataFrame) -> DataFrame:
    """Rally starts and ends, shots and bounces as one stream; ``place`` is the order within the clip."""
    row = lambda df, frame, kind, rank, ref: df.select("clip_id", F.col(frame).alias("frame"), F.lit(kind).alias("event"), F.lit(rank).alias("rank"), F.col(ref).cast("long").alias("ref"))
    rows = (row(rallies, "start_frame", "rally_start", 0, "rally_id").unionByName(row(shots, "frame", "shot", 1, "shot_id"))
            .unionByName(row(bounces, "frame", "bounce", 2, "bounce_id")).unionByName(row(rallies, "end_frame", "rally_end", 3, "rally_id")))
    return rows.withColumn("place", F.row_number().over(CLIP().orderBy("frame", "rank", "ref")))


def user_shot_groups(shots: DataFrame, roles: DataFrame) -> DataFrame:
    """The user's frames by kind of shot."""
    user = shots.join(roles.filter("role = 'user'"), ["clip_id", "track_id"], "left_semi")
    kind = F.when(F.col("seq") == 1, "serves").when(F.col("seq") == 2, "returns").when(F.col("seq") == 3, "third_shots").when(F.col("shot_type").isin("dink", "drop"), F.concat("shot_type", F.lit("s"))).when(F.col("is_volley"), "volleys").otherwise("others")
    return user.withColumn("group", kind).groupBy("clip_id", "group").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("frame")).alias("frames"))


def landing_links(bounces: DataFrame, shots: DataFrame, roles: DataFrame) -> DataFrame:
    """Bounces with the user's shot that made them."""
    user = shots.join(roles.filter("role = 'user'"), ["clip_id", "track_id"], "left_semi").select("clip_id", F.col("shot_id").alias("made_by"), "shot_type", F.col("frame").alias("hit_frame"))
    return bounces.join(user, ["clip_id", "made_by"]).select("clip_id", "bounce_id", "made_by", "shot_type", "hit_frame", F.col("frame").alias("landed_frame"), "court_x_ft", "court_y_ft")


def jump_list(rallies: DataFrame, fps: float = 60.0) -> DataFrame:
    length = (F.col("end_frame") - F.col("start_frame")) / fps
    return rallies.select("clip_id", "rally_id", F.greatest(F.lit(0.0), F.col("start_frame") / fps - 3).alias("seek_sec"), (length > 25).alias("likely_merged"))
