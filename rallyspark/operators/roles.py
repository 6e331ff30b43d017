"""Who is who: the user's segments from clicks, the user's track, and roles of all tracks of a clip."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import in_rect, px_per_ft
from .tracks import TRACK

# Fixed values. Seconds, shares and feet that make a track noise, another person, or a continuation.
MIN_LIFE_S, MIN_INSIDE, OVERLAP = 1.0, 0.15, 0.30
GAP_S, GAP_FT, HEIGHT_FT = 4.0, 12.0, 0.9
#: Weights of look, height and continuity; of continuity and height where a look is missing.
WITH_LOOK, WITHOUT_LOOK = (0.60, 0.25, 0.15), (0.6, 0.4)
#: The opening in which the user's corner is read, and the least distance of two players there.
OPENING_S, AMBIGUOUS_FT, COURT_FT = 12.0, 2.0, 20.0
#: Frames that a clicked track may be lost.
ABSENT = 30


def click_segments(players: DataFrame, clicks: DataFrame, absent: int = ABSENT) -> DataFrame:
    """Rows of the clicked track from each click(clip_id, click_id, frame, track_id) to the next, until it is lost for more
    than ``absent`` frames: clip_id, segment (the click's place), frame, track_id. Every row meets the last click by a window."""
    place = F.row_number().over(Window.partitionBy("clip_id").orderBy("frame", "click_id")) - 1
    marks = clicks.withColumn("segment", place).select("clip_id", "frame", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("track_id"), F.struct("segment", F.col("frame").alias("from"), F.col("track_id").cast("long").alias("track_id")).alias("click"))
    rows = players.select("clip_id", "frame", F.lit(1).alias("kind"), F.col("track_id").cast("long").alias("track_id"), F.lit(None).cast(marks.schema["click"].dataType).alias("click"))
    now = F.last("click", ignorenulls=True).over(Window.partitionBy("clip_id").orderBy("frame", "kind", "click.segment").rowsBetween(Window.unboundedPreceding, 0))
    own = marks.unionByName(rows).withColumn("click", now).filter("kind = 1 and track_id = click.track_id").select("clip_id", "click.segment", "click.from", "frame", "track_id").distinct()
    w = Window.partitionBy("clip_id", "segment").orderBy("frame")
    lost = F.col("frame") - F.coalesce(F.lag("frame").over(w), F.col("from")) > absent + 1
    return own.withColumn("lost", lost).withColumn("lost", F.max("lost").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter("not lost").select("clip_id", "segment", "frame", "track_id")


def click_gaps(segments: DataFrame, players: DataFrame, clicks: DataFrame, absent: int = ABSENT) -> DataFrame:
    """Where a clicked track was lost before the next click or the clip's end: clip_id, segment, last_user_frame, resumes_at_or_after."""
    w = Window.partitionBy("clip_id").orderBy("frame", "click_id")
    ends = players.groupBy("clip_id").agg((F.max("frame") + 1).alias("end"))
    spans = clicks.withColumns({"segment": F.row_number().over(w) - 1, "next": F.lead("frame").over(w)}).join(ends, "clip_id")
    seen = segments.groupBy("clip_id", "segment").agg(F.max("frame").alias("seen"))
    rows = spans.join(seen, ["clip_id", "segment"], "left").select("clip_id", "segment", F.coalesce("seen", "frame").alias("last_user_frame"), F.coalesce("next", "end").alias("until"))
    return rows.withColumn("resumes_at_or_after", F.col("last_user_frame") + absent + 1).filter("resumes_at_or_after < until").drop("until")


def track_rows(players: DataFrame, court: DataFrame, signatures: DataFrame | None = None) -> DataFrame:
    """One row per track: rows, first and last frame and place, medians, height in feet, shares, the runs of its frames, its
    signature, and its side: near, far or noise."""
    place = F.struct(F.col("court_x_ft").alias("x"), F.col("court_y_ft").alias("y"))
    per = players.groupBy(*TRACK).agg(
        F.count("*").alias("n"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.min_by(place, "frame").alias("first"), F.max_by(place, "frame").alias("last"),
        F.percentile("court_x_ft", F.lit(0.5)).alias("median_x"), F.percentile("court_y_ft", F.lit(0.5)).alias("median_y"), F.percentile(F.col("bbox_y2") - F.col("bbox_y1"), F.lit(0.75)).alias("height_px"),
        F.avg(F.coalesce(in_rect(F.col("court_x_ft"), F.col("court_y_ft"), 5, 15), F.lit(False)).cast("int")).alias("inside"), F.avg(F.col("is_user").cast("int")).alias("user_share"))
    island = F.col("frame") - F.row_number().over(Window.partitionBy(*TRACK).orderBy("frame"))
    runs = players.select(*TRACK, "frame").distinct().withColumn("island", island).groupBy(*TRACK, "island").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    runs = runs.groupBy(*TRACK).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))
    rows = per.join(runs, TRACK).join(court.select("clip_id", "fps", "near_px_per_ft", "far_px_per_ft"), "clip_id")
    rows = rows.join(signatures, TRACK, "left") if signatures is not None else rows.withColumn("signature", F.lit(None).cast("array<double>"))
    tall = F.try_divide(F.col("height_px"), px_per_ft(F.col("median_y"), F.col("near_px_per_ft"), F.col("far_px_per_ft")))
    short = (F.col("last_frame") - F.col("first_frame") + 1) / F.col("fps") < MIN_LIFE_S
    outside = ~F.coalesce(in_rect(F.col("median_x"), F.col("median_y"), 5, 15), F.lit(False))
    side = F.when(short | outside | (F.col("inside") < MIN_INSIDE), "noise").when(F.col("median_y") < 22, "near").otherwise("far")
    return rows.withColumns({"height_ft": tall, "side": side, "signature": F.col("signature").cast("array<double>")}).drop("height_px", "near_px_per_ft", "far_px_per_ft", "inside")


def seed_user(tracks: DataFrame, players: DataFrame, court: DataFrame) -> DataFrame:
    """The user's first tracks, from track_rows() and ``court(clip_id, fps, user_corner)``: near tracks that were clicked, else the
    near track that stands furthest to the user's corner in the opening seconds (over all its life if none is seen then).

    clip_id, track_id, confidence, basis; a clip without near tracks or without a corner has none."""
    near = tracks.filter("side = 'near'")
    clicked = near.filter("user_share > 0").select(*TRACK, F.lit(0.95).alias("confidence"), F.lit("click").alias("basis"))
    rest = near.join(clicked.select("clip_id").distinct(), "clip_id", "left_anti").join(court.filter("user_corner in ('left', 'right')").select("clip_id", "user_corner"), "clip_id")
    start = F.min("frame").over(Window.partitionBy("clip_id"))
    opening = players.withColumn("start", start).join(court.select("clip_id", "fps"), "clip_id").filter(F.col("frame") <= F.col("start") + OPENING_S * F.col("fps"))
    early = opening.groupBy(*TRACK).agg(F.percentile("court_x_ft", F.lit(0.5)).alias("early_x"))
    any_early = F.count("early_x").over(Window.partitionBy("clip_id")) > 0
    x = rest.join(early, TRACK, "left").withColumns({"late": ~any_early}).withColumn("at", F.when(F.col("late"), F.col("median_x")).otherwise(F.col("early_x"))).filter("at is not null")
    w = Window.partitionBy("clip_id").orderBy(F.when(F.col("user_corner") == "left", F.col("at")).otherwise(-F.col("at")), "track_id")
    apart = F.abs(F.col("at") - F.lead("at").over(w))
    sure = F.when(apart.isNull(), 0.7).otherwise(F.least(F.lit(0.9), 0.5 + 0.4 * F.least(F.lit(1.0), apart / COURT_FT), F.when(apart < AMBIGUOUS_FT, 0.5)))
    picked = x.withColumns({"place": F.row_number().over(w), "confidence": sure}).filter("place = 1")
    return clicked.unionByName(picked.select(*TRACK, "confidence", F.when(F.col("late"), "overall corner").otherwise("opening corner").alias("basis")))


class Person:
    """What is known of one of two people on a side: the frames they are seen in, their tracks, look and height."""

    def __init__(self, frames: int):
        self.seen, self.tracks, self.look, self.height = np.zeros(frames, bool), [], None, np.nan

    def add(self, t: dict, seen: bool = True, learn: bool = True) -> None:
        """Takes a track; with ``learn`` its look and height stand in for unknown ones."""
        self.tracks.append(t)
        if seen:
            self.seen[t["at"]] = True
        if learn:
            self.look = t["look"] if self.look is None else self.look
            self.height = t["height"] if np.isnan(self.height) else self.height

    def share(self, t: dict) -> float:
        """How much of a track's frames this person is seen in elsewhere."""
        return self.seen[t["at"]].sum() / max(1, t["n"])

    def cues(self, t: dict, fps: float) -> tuple[float | None, float, float]:
        """Similarity of look (None if unknown) and height, and how well the track continues one of theirs."""
        look = None
        if self.look is not None and t["look"] is not None:
            size = np.linalg.norm(self.look) * np.linalg.norm(t["look"])
            look = float(self.look @ t["look"] / size) if size > 1e-9 else 0.0
        tall = 0.5 if np.isnan(self.height) or np.isnan(t["height"]) else max(0.0, 1 - abs(t["height"] - self.height) / HEIGHT_FT)
        follows = 0.0
        for before, after in [(u, t) for u in self.tracks] + [(t, u) for u in self.tracks]:
            gap = (after["a"] - before["b"]) / fps
            if 0 <= gap <= GAP_S and (far := np.hypot(before["last"][0] - after["first"][0], before["last"][1] - after["first"][1])) <= GAP_FT:
                follows = max(follows, (1 - gap / GAP_S) * (1 - far / GAP_FT))
        return look, tall, follows


def _likelier(t: dict, a: Person, b: Person, fps: float, cap: float) -> tuple[bool, float, str]:
    """Whether the track is rather a's than b's, how sure, and by which cues."""
    (look_a, *rest_a), (look_b, *rest_b) = a.cues(t, fps), b.cues(t, fps)
    if look_a is not None and look_b is not None:
        score, basis = [np.dot(WITH_LOOK, (look, *rest)) for look, rest in ((look_a, rest_a), (look_b, rest_b))], "look and height"
    else:
        score, basis = [np.dot(WITHOUT_LOOK, rest[::-1]) for rest in (rest_a, rest_b)], "continuity and height"
    return bool(score[0] >= score[1]), round(float(min(cap, 0.5 + abs(score[0] - score[1]))), 3), basis


def _longest_beside(tracks: list[dict], a: Person) -> dict | None:
    """The longest track that shares its time with a person, so it is another's."""
    return next((t for t in sorted(tracks, key=lambda t: -t["n"]) if a.share(t) > OVERLAP), None)


def _near_roles(tracks: list[dict], seeds: dict[int, tuple[float, str]], frames: int, fps: float) -> list[tuple]:
    """User and partner: whoever is seen beside the user is the partner; all others go to whom they resemble more."""
    user, partner, out = Person(frames), Person(frames), []
    own = [t for t in tracks if t["id"] in seeds]
    for t in own:
        user.add(t, learn=False)  # the user stays what these tracks say
        out.append((t["id"], "user", round(seeds[t["id"]][0], 3), seeds[t["id"]][1]))
    if not own:
        return [(t["id"], None, 0.0, "no user known") for t in tracks]
    looks, tall = [t["look"] for t in own if t["look"] is not None], [t for t in own if not np.isnan(t["height"])]
    user.look = np.mean(looks, axis=0) if looks else None
    user.height = sum(t["height"] * t["n"] for t in tall) / sum(t["n"] for t in tall) if tall else np.nan
    rest = [t for t in tracks if t["id"] not in seeds]
    anchor = _longest_beside(rest, user)
    if anchor:
        partner.add(anchor, False)
    for t in sorted(rest, key=lambda t: t["a"]):
        if user.share(t) > OVERLAP:
            partner.add(t)
            out.append((t["id"], "partner", 0.8, "seen beside the user"))
            continue
        is_user, sure, basis = _likelier(t, user, partner, fps, 0.95)
        (user if is_user else partner).add(t, learn=not is_user)
        out.append((t["id"], "user" if is_user else "partner", sure, basis))
    return out


def _far_roles(tracks: list[dict], frames: int, fps: float) -> list[tuple]:
    """Two opponents around the longest track and the longest one beside it; who is seen beside both is a third person."""
    a, b = Person(frames), Person(frames)
    tracks = sorted(tracks, key=lambda t: -t["n"])
    a.add(tracks[0])
    out, second = [(tracks[0]["id"], "opp_a", 0.6, "longest")], _longest_beside(tracks[1:], a)
    if second:
        b.add(second)
        out.append((second["id"], "opp_b", 0.6, "seen beside opp_a"))
    for t in sorted([t for t in tracks[1:] if t is not second], key=lambda t: (t["a"], t["id"])):
        with_a, with_b = a.share(t) > OVERLAP, second is not None and b.share(t) > OVERLAP
        if with_a and with_b:
            out.append((t["id"], "noise", 0.8, "third person"))
            continue
        if with_a and second is not None:
            is_a, sure, basis = False, 0.6, "seen beside opp_a"
        elif with_b:
            is_a, sure, basis = True, 0.6, "seen beside opp_b"
        else:
            is_a, sure, basis = _likelier(t, a, b, fps, 0.75)
            is_a = is_a or second is None
        (a if is_a else b).add(t)
        out.append((t["id"], "opp_a" if is_a else "opp_b", sure, basis))
    return out


def assign_roles(tracks: DataFrame, seeds: DataFrame) -> DataFrame:
    """clip_id, track_id, role, confidence, basis of each track, from track_rows() and seed_user().

    Each assignment changes what the next one is held against, so the live tracks of a clip (rows with runs of frames, not
    frames) are one group, as large as the clip's number of tracks. Tracks on the near side of a clip without a seed have no role."""
    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("track_id")
        start, fps, rows = int(g["first_frame"].min()), float(g["fps"].iloc[0]), []
        for r in g.itertuples():
            at = np.concatenate([np.arange(run["a"], run["b"] + 1) for run in r.runs]) - start
            rows.append({"id": r.track_id, "n": r.n, "a": r.first_frame, "b": r.last_frame, "at": at, "first": (r.first["x"], r.first["y"]), "last": (r.last["x"], r.last["y"]), "side": r.side,
                         "height": np.nan if r.height_ft is None else float(r.height_ft), "look": None if r.signature is None else np.asarray(r.signature, float)})
        frames = int(g["last_frame"].max()) - start + 1
        near, far = [t for t in rows if t["side"] == "near"], [t for t in rows if t["side"] == "far"]
        first = {r.track_id: (r.confidence, r.basis) for r in g.itertuples() if r.basis is not None}
        out = (_near_roles(near, first, frames, fps) if near else []) + (_far_roles(far, frames, fps) if far else [])
        return pd.DataFrame([(g["clip_id"].iloc[0], *o) for o in out], columns=["clip_id", "track_id", "role", "confidence", "basis"])

    live = tracks.filter("side <> 'noise'").join(seeds, TRACK, "left").withColumns({c: F.col(c).cast("long") for c in TRACK})
    noise = tracks.filter("side = 'noise'").select(*[F.col(c).cast("long") for c in TRACK], F.lit("noise").alias("role"), F.lit(0.9).alias("confidence"), F.lit("short or outside").alias("basis"))
    return live.groupBy("clip_id").applyInPandas(solve, "clip_id long, track_id long, role string, confidence double, basis string").unionByName(noise)


def role_coverage(players: DataFrame, roles: DataFrame) -> DataFrame:
    """Per clip: tracks in all, with a role and noise; the share of frames in which the user is known by role, and by clicks."""
    rows = players.join(roles.select(*TRACK, "role"), TRACK, "left")
    any_ = lambda c: F.bool_or(F.coalesce(c, F.lit(False)))
    named = rows.filter("track_id is not null").groupBy(*TRACK).agg(any_(F.col("role") != "noise").alias("assigned"), any_(F.col("role") == "noise").alias("noise"))
    seen = rows.groupBy("clip_id", "frame").agg(any_(F.col("role") == "user").alias("user"), any_(F.col("is_user")).alias("clicked"))
    of_tracks = named.groupBy("clip_id").agg(F.count("*").alias("tracks"), F.count_if("assigned").alias("assigned"), F.count_if("noise").alias("noise"))
    share = lambda c: F.count(F.when(F.col(c), F.col("frame"))) / (F.max("frame") + 1)
    of_frames = seen.groupBy("clip_id").agg(share("user").alias("user_coverage"), share("clicked").alias("click_coverage"))
    return of_frames.join(of_tracks, "clip_id", "left").na.fill(0, ["tracks", "assigned", "noise"]).select("clip_id", "tracks", "assigned", "noise", "user_coverage", "click_coverage")
