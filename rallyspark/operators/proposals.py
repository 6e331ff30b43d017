"""Stretches of a clip that are worth labelling: where the ball detector is unsure or loses the ball."""

from __future__ import annotations

import bisect

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ball import W
from .helpers import chains

# A confidence that is low, a dropout's least frames, seconds that merge and that a range needs, a share of
# dropout that means that the ball is gone, and frames per label.
LOW, DROPOUT, MERGE_S, LEAST_S, GONE, EVERY = 0.40, 4, 1.0, 0.5, 0.98, 3
#: Fixed value: seconds between picked ranges that become one.
JOIN_S = 4.0
BUCKET = 256


def trouble_frames(ball: DataFrame, labelled: DataFrame) -> DataFrame:
    """The ball's rows with ``trouble``: seen with low confidence, or in an unseen run of DROPOUT rows or more; never within the
    labelled span of its clip. ``visible`` null counts as unseen."""
    seen = F.coalesce("visible", F.lit(False))
    rows = ball.select("clip_id", "frame", seen.alias("visible"), F.when(seen, F.nanvl(F.col("confidence"), F.lit(None))).alias("confidence"))
    change = F.coalesce((F.col("visible") != F.lag("visible").over(W())).cast("int"), F.lit(0))
    rows = rows.withColumn("run", F.sum(change).over(W().rowsBetween(Window.unboundedPreceding, 0)))  # equal values of a column of changes
    rows = rows.withColumn("run_rows", F.count("*").over(Window.partitionBy("clip_id", "run")))
    span = labelled.groupBy("clip_id").agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    bad = F.when(F.col("visible"), F.coalesce("confidence", F.lit(0.0)) < LOW).otherwise(F.col("run_rows") >= DROPOUT)
    return rows.join(span, "clip_id", "left").withColumn("trouble", bad & ~F.coalesce(F.col("frame").between(F.col("lo"), F.col("hi")), F.lit(False))).select("clip_id", "frame", "visible", "confidence", "trouble")


def grow_ranges(rows: DataFrame, court: DataFrame) -> DataFrame:
    """Ranges (clip_id, start, until) that begin at a troubled frame and take what follows: everything within three times the
    merging gap of the start, and troubled frames beyond it; frames missing for longer than the gap end them too, unless trouble
    follows. The next range begins at the next troubled frame.

    ``rows`` are trouble_frames(). Only runs of troubled rows and the holes between rows meet in a group; runs further apart than
    a range can reach don't affect each other, so groups are chains of near runs."""
    after = Window.partitionBy("clip_id").orderBy("frame")
    marked = rows.join(court.select("clip_id", F.floor(MERGE_S * F.col("fps")).cast("long").alias("gap")), "clip_id").withColumns(
        {"entry": F.coalesce(F.lag("frame").over(after) + 1, F.col("frame")), "next": F.lead("frame").over(after), "next_trouble": F.lead("trouble").over(after)})
    island = F.sum((~F.col("trouble")).cast("long")).over(after.rowsBetween(Window.unboundedPreceding, 0))
    runs = marked.withColumn("island", island).filter("trouble").groupBy("clip_id", "island", "gap").agg(F.min("frame").alias("frame"), F.min("entry").alias("entry"), F.max("frame").alias("end"))
    holes = marked.filter("next - frame > gap and not next_trouble").select("clip_id", "frame", F.col("frame").alias("entry"), F.col("frame").alias("end"), "gap", F.lit(True).alias("hole"))
    events = runs.select("clip_id", "frame", "entry", "end", "gap", F.lit(False).alias("hole")).unionByName(holes).withColumns({"reach": 3 * F.col("gap"), "beyond": 3 * F.col("gap") + 1})
    # ``at`` adds up the stretches without trouble, so that it jumps where no open range can reach across.
    idle = F.greatest(F.lit(0).cast("long"), F.col("entry") - F.max("end").over(after.rowsBetween(Window.unboundedPreceding, -1)))
    laid = events.withColumn("idle", F.coalesce(idle, F.lit(0).cast("long"))).withColumn("at", F.sum("idle").over(after.rowsBetween(Window.unboundedPreceding, 0)))

    def grow(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["frame", "hole"])
        clip, reach = g["clip_id"].iloc[0], int(g["reach"].iloc[0])
        runs, holes = g[~g["hole"]], g[g["hole"]]["frame"].tolist()
        starts, entries, ends, out, i = runs["frame"].tolist(), runs["entry"].tolist(), runs["end"].tolist(), [], 0
        while i < len(starts):
            until = starts[i] + reach
            k = bisect.bisect_right(entries, until + 1) - 1
            until = max(until, ends[k])  # in trouble beyond the reach
            h = bisect.bisect_left(holes, starts[i])
            if h < len(holes):
                until = min(until, holes[h])
            out.append((clip, starts[i], until))
            i = max(i + 1, bisect.bisect_right(ends, until))
        return pd.DataFrame(out, columns=["clip_id", "start", "until"])

    chained = chains(laid, ["clip_id"], "at", "beyond", ["frame"]).select(F.col("clip_id").cast("long"), "frame", "entry", "end", "hole", "reach", "chunk")
    return chained.groupBy("clip_id", "chunk").applyInPandas(grow, "clip_id long, start long, until long")


def troubled_ranges(ball: DataFrame, labelled: DataFrame, court: DataFrame) -> DataFrame:
    """Ranges of half a second or more with their last frame, seconds, number of labels, share of dropout, median confidence, and
    whether the ball seems to be gone. Rows meet ranges by clip and bucket of frames."""
    rows = trouble_frames(ball, labelled)
    bucket = F.floor(F.col("frame") / BUCKET)
    spans = grow_ranges(rows, court).withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / BUCKET), F.floor(F.col("until") / BUCKET))))
    inside = rows.withColumn("bucket", bucket).join(spans, ["clip_id", "bucket"]).filter("frame between start and until")
    out = inside.groupBy("clip_id", F.col("start").alias("start_frame")).agg(
        F.max("frame").alias("end_frame"), F.round(F.avg((~F.col("visible")).cast("int")), 2).alias("dropout_share"), F.round(F.coalesce(F.percentile("confidence", F.lit(0.5)), F.lit(0.0)), 2).alias("median_confidence"))
    length = F.col("end_frame") - F.col("start_frame")
    return out.join(court.select("clip_id", "fps"), "clip_id").filter(length / F.col("fps") >= LEAST_S).select(
        "clip_id", "start_frame", "end_frame", F.round(length / F.col("fps"), 2).alias("seconds"), (F.floor(length / EVERY) + 1).cast("long").alias("n_labels"), "dropout_share", "median_confidence", (F.col("dropout_share") > GONE).alias("likely_absent"))


def propose_labels(ranges: DataFrame, court: DataFrame, budget: int = 300) -> DataFrame:
    """The ranges to label, least sure first and those without a ball last, until ``budget`` labels are spent; a range close to a
    picked one joins it. A group is the ranges of one clip."""
    fields = "clip_id long, start_frame long, end_frame long, n_labels long, median_confidence double, likely_absent boolean"

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        near, picked = int(JOIN_S * g["fps"].iloc[0]), []
        for r in g.sort_values(["likely_absent", "median_confidence", "start_frame"]).itertuples():
            if sum((b - a) // EVERY + 1 for a, b, *_ in picked) >= budget:
                break
            for p in picked:
                if (r.start_frame >= p[0] and r.start_frame - p[1] <= near) or (r.end_frame <= p[1] and p[0] - r.end_frame <= near):
                    p[:3] = [min(p[0], r.start_frame), max(p[1], r.end_frame), min(p[2], r.median_confidence)]
                    break
            else:
                picked.append([r.start_frame, r.end_frame, r.median_confidence, r.likely_absent])
        return pd.DataFrame([(g["clip_id"].iloc[0], a, b, (b - a) // EVERY + 1, c, gone) for a, b, c, gone in picked], columns=[f.split()[0] for f in fields.split(", ")])

    return ranges.join(court.select("clip_id", "fps"), "clip_id").select(F.col("clip_id").cast("long"), F.col("start_frame").cast("long"), F.col("end_frame").cast("long"), "median_confidence", "likely_absent", "fps").groupBy("clip_id").applyInPandas(pick, fields)
