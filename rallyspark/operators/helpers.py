"""The few truly sequential rules, as small grouped helpers. Groups are independent components, never whole tables."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A chunk holds about so many rows, and the rest of its last chain.
CHUNK_ROWS = 20_000


def chains(df: DataFrame, key: list[str], order: str, gap: float | str, ties: list[str] | None = None, breaks: str | None = None) -> DataFrame:
    """Adds ``chunk``: rows of a key whose neighbours in ``order`` are at most ``gap`` (a number or a column) apart are a chain,
    and a chunk is a run of whole chains of about CHUNK_ROWS rows. A change of the column ``breaks`` ends a chain too."""
    w = Window.partitionBy(*key).orderBy(order, *(ties or []))
    gap = F.col(gap) if isinstance(gap, str) else F.lit(gap)
    starts = F.coalesce(F.col(order) - F.lag(order).over(w) > gap, F.lit(True))
    if breaks:
        starts = starts | ~F.col(breaks).eqNullSafe(F.lag(breaks).over(w))
    first = F.max(F.when(F.col("start_"), F.col("row_"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumns({"start_": starts, "row_": F.row_number().over(w)}).withColumn("chunk", F.floor(first / CHUNK_ROWS)).drop("start_", "row_")


def suppress_neighbours(cands: DataFrame, window: int | str) -> DataFrame:
    """Greedy by score (ties: earlier frame): a candidate stays unless an accepted one is within ``window`` frames (a number,
    or a column that is the same over a clip)."""
    fields = cands.schema

    def keep(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["score", "frame"], ascending=[False, True], ignore_index=True)
        near = int(g[window].iloc[0]) if isinstance(window, str) else window
        taken: list[int] = []
        mask = []
        for f in g["frame"]:
            at = bisect.bisect_left(taken, f)
            ok = (at == 0 or f - taken[at - 1] > near) and (at == len(taken) or taken[at] - f > near)
            mask.append(ok)
            if ok:
                taken.insert(at, f)
        return g.loc[mask, fields.names]

    return chains(cands, ["clip_id"], "frame", window).groupBy("clip_id", "chunk").applyInPandas(keep, fields)


def refractory(events: DataFrame, gap: float, time: str = "frame") -> DataFrame:
    """In order of time (ties: of the other columns), an event stays if it comes more than ``gap`` after the last one that stayed."""
    fields = events.schema

    def keep(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values([time, *[c for c in fields.names if c != time]], ignore_index=True)
        last, mask = None, []
        for t in g[time]:
            ok = last is None or t - last > gap
            mask.append(ok)
            last = t if ok else last
        return g.loc[mask, fields.names]

    return chains(events, ["clip_id"], time, gap).groupBy("clip_id", "chunk").applyInPandas(keep, fields)


def match_one_to_one(truth: DataFrame, got: DataFrame, tolerance: int) -> DataFrame:
    """Exclusive pairs (clip_id, truth_id, got_id, distance), closest first (ties: truth, then got).

    Candidate pairs come from a join by clip and frame bucket; a pair can only compete within a chain of truth and got
    frames that lie within the tolerance of each other, so each chain is matched by itself.
    """
    both = truth.select("clip_id", "frame", F.lit(0).alias("side"), F.col("truth_id").alias("id")).unionByName(got.select("clip_id", "frame", F.lit(1).alias("side"), F.col("got_id").alias("id")))

    def match(g: pd.DataFrame) -> pd.DataFrame:
        t, o = g[g["side"] == 0].sort_values("frame"), g[g["side"] == 1].sort_values("frame")
        pairs, at = [], 0
        frames, ids = o["frame"].tolist(), o["id"].tolist()
        for f, i in zip(t["frame"], t["id"]):
            while at < len(frames) and frames[at] < f - tolerance:
                at += 1
            k = at
            while k < len(frames) and frames[k] <= f + tolerance:
                pairs.append((abs(frames[k] - f), i, ids[k]))
                k += 1
        used_t, used_o, out = set(), set(), []
        for d, i, j in sorted(pairs):
            if i not in used_t and j not in used_o:
                used_t.add(i)
                used_o.add(j)
                out.append((g["clip_id"].iloc[0], i, j, d))
        return pd.DataFrame(out, columns=["clip_id", "truth_id", "got_id", "distance"])

    return chains(both, ["clip_id"], "frame", tolerance).groupBy("clip_id", "chunk").applyInPandas(match, "clip_id long, truth_id long, got_id long, distance long")


def dedup_serves(serves: DataFrame, within: int | str) -> DataFrame:
    """Of neighbouring serves at most ``within`` frames apart with no impulse between, the one of the shorter run goes (ties:
    the later); a serve that has gone starts no further pair. ``upto`` and ``before`` count the clip's impulses up to each
    serve, with and without its own frame."""
    fields = serves.schema

    def keep(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("frame", ignore_index=True)
        frames, runs, upto, before = (g[c].tolist() for c in ("frame", "run_length", "upto", "before"))
        near = int(g[within].iloc[0]) if isinstance(within, str) else within
        gone = set()
        for i in range(len(g) - 1):
            if i not in gone and frames[i + 1] - frames[i] <= near and before[i + 1] == upto[i]:
                gone.add(i if runs[i] < runs[i + 1] else i + 1)
        return g.loc[[i not in gone for i in range(len(g))], fields.names]

    return chains(serves, ["clip_id"], "frame", within).groupBy("clip_id", "chunk").applyInPandas(keep, fields)


def same_track_repeats(shots: DataFrame, within: int | str) -> DataFrame:
    """A player's next shot less than ``within`` frames after the shot kept last, with no other player between: a serve
    that is held stays, else the later one does. Another player's shot starts anew, so chains end there too."""
    fields = shots.schema

    def keep(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["frame", "shot_id"], ignore_index=True)
        near = int(g[within].iloc[0]) if isinstance(within, str) else within
        kept: list[int] = []
        for i, (frame, track) in enumerate(zip(g["frame"], g["track_id"])):
            if kept and g["track_id"][kept[-1]] == track and frame - g["frame"][kept[-1]] < near:
                if not g["is_serve"][kept[-1]]:
                    kept[-1] = i
            else:
                kept.append(i)
        return g.loc[kept, fields.names]

    return chains(shots, ["clip_id"], "frame", within, ["shot_id"], "track_id").groupBy("clip_id", "chunk").applyInPandas(keep, fields)


def accept_serves(shots: DataFrame) -> DataFrame:
    """The serves among the candidates of a clip: the first, one after a point's end, one ``inter_serve`` frames after the serve
    accepted last; another that is returned replaces one that isn't. A pause of ``inter_serve`` frames starts anew."""
    fields = shots.schema

    def keep(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("frame", ignore_index=True)
        frames, returned, pause = g["frame"].tolist(), g["returned"].tolist(), int(g["inter_serve"].iloc[0])
        accepted: list[int] = []
        ended = -1
        for i, (candidate, end) in enumerate(zip(g["candidate"], g["is_end"])):
            if end:
                ended = i
            if not candidate:
                continue
            if not accepted or ended > accepted[-1] or frames[i] - frames[accepted[-1]] >= pause:
                accepted.append(i)
            elif returned[i] is True and returned[accepted[-1]] is not True:
                accepted[-1] = i
        return g.loc[accepted, fields.names]

    # A gap of exactly inter_serve frames starts anew too.
    less = shots.withColumn("gap_", F.col("inter_serve") - 1)
    return chains(less, ["clip_id"], "frame", "gap_").drop("gap_").groupBy("clip_id", "chunk").applyInPandas(keep, fields)


#: Fixed values of the track selection: picks, frames and pixels.
MAX_STEP, LINK_GAP, RESTART, STILL_STEP, STILL_WEIGHT, SKIP, ACCEPT, SUPPORT = 160.0, 8, 2.5, 2.0, 0.8, 0.05, 0.30, 2


def select_track(candidates: DataFrame) -> DataFrame:
    """One candidate per frame such that the whole path is the most plausible: (clip_id, frame, x, y, confidence).

    ``candidates(clip_id, frame, k, x, y, confidence)``. A clip's best path is found forwards: each pick continues from the
    best pick of the LINK_GAP frames before (all candidates of a frame at once), or starts again from the best of all
    earlier ones at a cost. Weak picks stay only near strong ones, and don't support each other. A group is one clip: its
    size is the clip's length, not the table's."""
    import numpy as np

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["frame", "k"], ignore_index=True)
        frame, x, y, c = (g[name].to_numpy(float) for name in ("frame", "x", "y", "confidence"))
        n = len(g)
        score, prev, best_of, best_at = np.zeros(n), np.full(n, -1), 0.0, -1
        heads = np.flatnonzero(np.r_[True, frame[1:] != frame[:-1]])
        tails = np.r_[heads[1:], n]
        low = 0
        for a, b in zip(heads, tails):
            while frame[low] < frame[a] - LINK_GAP:
                low += 1
            here, back = np.arange(a, b), np.arange(low, a)
            score[here], prev[here] = best_of - RESTART + c[here], best_at
            if len(back):
                gap = frame[a] - frame[back]
                d = np.hypot(x[here][:, None] - x[back], y[here][:, None] - y[back])
                s = score[back] + c[here][:, None] - d / (MAX_STEP * gap) - STILL_WEIGHT * np.maximum(0, 1 - d / gap / STILL_STEP) - SKIP * (gap - 1)
                s[d > MAX_STEP * gap] = -np.inf
                order = np.lexsort((np.arange(len(back)), gap))  # on ties the nearest frame, then the first candidate
                pick = order[np.argmax(s[:, order], axis=1)]
                top = s[np.arange(len(here)), pick]
                better = top > score[here]
                score[here[better]], prev[here[better]] = top[better], back[pick[better]]
            m = a + int(np.argmax(score[a:b]))
            if score[m] > best_of:
                best_of, best_at = score[m], m
        i, path = int(np.argmax(score)), []
        while i >= 0:
            path.append(i)
            i = int(prev[i])
        return g.loc[path[::-1], ["clip_id", "frame", "x", "y", "confidence"]]

    path = candidates.groupBy("clip_id").applyInPandas(solve, "clip_id long, frame long, x double, y double, confidence double")
    w = Window.partitionBy("clip_id").orderBy("frame").rangeBetween(-SUPPORT, SUPPORT)
    strong = F.max((F.col("confidence") >= ACCEPT).cast("int")).over(w)
    return path.withColumn("strong", strong).filter((F.col("confidence") >= ACCEPT) | (F.col("strong") == 1)).drop("strong")


def follow_shot(shots: DataFrame, ball: DataFrame, frames: int = 90, step: float = 280.0, misses: int = 10) -> DataFrame:
    """The ball's path after each contact: (clip_id, shot_id, frame, x, y), the contact first. From the last point taken, the
    next visible one within ``step`` pixels is taken; ``misses`` frames in a row without one end the path.

    ``shots(clip_id, shot_id, frame, x, y)`` meet the ball by clip and bucket; a group is one shot, 90 frames at most."""
    near = shots.select("clip_id", "shot_id", F.col("frame").alias("at"), F.col("x").alias("x0"), F.col("y").alias("y0"), F.explode(F.sequence(F.floor(F.col("frame") / frames), F.floor(F.col("frame") / frames) + 1)).alias("bucket"))
    rows = near.join(ball.select("clip_id", "frame", "visible", "pixel_x", "pixel_y", F.floor(F.col("frame") / frames).alias("bucket")), ["clip_id", "bucket"]).filter((F.col("frame") > F.col("at")) & (F.col("frame") <= F.col("at") + frames))

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("frame")
        clip, shot, x, y = g["clip_id"].iloc[0], g["shot_id"].iloc[0], g["x0"].iloc[0], g["y0"].iloc[0]
        out, missed = [(clip, shot, g["at"].iloc[0], x, y)], 0
        for f, seen, px, py in zip(g["frame"], g["visible"], g["pixel_x"], g["pixel_y"]):
            if seen and px == px and ((px - x) ** 2 + (py - y) ** 2) ** 0.5 <= step:
                x, y, missed = px, py, 0
                out.append((clip, shot, f, x, y))
            else:
                missed += 1
                if missed >= misses:
                    break
        return pd.DataFrame(out, columns=["clip_id", "shot_id", "frame", "x", "y"])

    return rows.groupBy("clip_id", "shot_id").applyInPandas(walk, "clip_id long, shot_id long, frame long, x double, y double")


def first_unused(truth: DataFrame, got: DataFrame, within: int) -> DataFrame:
    """In the order of ``truth``, the first row of ``got`` within ``within`` frames that no earlier one took: (clip_id,
    truth_id, got_id). Both are in the order of their ids; rows further apart than ``within`` don't compete."""
    both = truth.select("clip_id", "frame", F.lit(0).alias("side"), F.col("truth_id").alias("id")).unionByName(got.select("clip_id", "frame", F.lit(1).alias("side"), F.col("got_id").alias("id")))

    def match(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        t, o = g[g["side"] == 0], g[g["side"] == 1].sort_values(["frame", "id"])
        frames, ids = o["frame"].tolist(), o["id"].tolist()
        used, out = set(), []
        for f, i in zip(t["frame"], t["id"]):
            a, b = bisect.bisect_left(frames, f - within), bisect.bisect_right(frames, f + within)
            free = [j for j in ids[a:b] if j not in used]
            if free:
                used.add(min(free))
                out.append((g["clip_id"].iloc[0], i, min(free)))
        return pd.DataFrame(out, columns=["clip_id", "truth_id", "got_id"])

    return chains(both, ["clip_id"], "frame", within).groupBy("clip_id", "chunk").applyInPandas(match, "clip_id long, truth_id long, got_id long")


def merge_ends(ends: DataFrame, pause: int) -> DataFrame:
    """In order of frames, an end stays if it comes ``pause`` frames or more after the last one that stayed."""
    fields = ends.schema

    def keep(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["frame", "by_shot"], ignore_index=True)
        kept, last = [], None
        for i, f in enumerate(g["frame"]):
            if last is None or f - last >= pause:
                kept.append(i)
                last = f
        return g.loc[kept, fields.names]

    return chains(ends, ["clip_id"], "frame", pause - 1).groupBy("clip_id", "chunk").applyInPandas(keep, fields)
