"""Queries on calibration, label proposals, crossings in 3-D and the chain's counters, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import calibration as K
from ..operators import chain as C
from ..operators import proposals as O

_W = "PARTITION BY clip_id ORDER BY frame"
# A chain of ranges by pointers: where each troubled frame's range would end, and the first troubled frame after it.
_RANGES = f"""lb AS (SELECT clip_id, min(frame) AS lo, max(frame) AS hi FROM fx_labels WHERE frame < 400 GROUP BY clip_id),
    vr AS (SELECT *, sum(ch) OVER ({_W}) AS run FROM (SELECT clip_id, frame, visible, CASE WHEN visible THEN confidence END AS confidence, CASE WHEN visible <> lag(visible) OVER ({_W}) THEN 1 ELSE 0 END AS ch FROM fx_ball)),
    tr AS (SELECT vr.clip_id, frame, visible, confidence, CASE WHEN visible THEN coalesce(confidence, 0) < 0.40 ELSE count(*) OVER (PARTITION BY vr.clip_id, run) >= 4 END AND NOT coalesce(frame BETWEEN lo AND hi, false) AS trouble FROM vr LEFT JOIN lb USING (clip_id)),
    ti AS (SELECT *, frame - row_number() OVER ({_W}) AS island FROM tr WHERE trouble), tn AS (SELECT clip_id, min(frame) AS a, max(frame) AS b FROM ti GROUP BY clip_id, island),
    tu AS (SELECT t.clip_id, t.frame, coalesce(b, t.frame + CAST(3 * fps AS BIGINT)) AS until FROM ti t JOIN fx_court c USING (clip_id) LEFT JOIN tn ON tn.clip_id = t.clip_id AND t.frame + CAST(3 * fps AS BIGINT) + 1 BETWEEN a AND b),
    tp AS (SELECT u.clip_id, u.frame, u.until, n.frame AS next FROM tu u ASOF LEFT JOIN ti n ON n.clip_id = u.clip_id AND n.frame > u.until),
    gr(clip_id, frame, until, next) AS (SELECT * FROM tp WHERE (clip_id, frame) IN (SELECT (clip_id, min(frame)) FROM ti GROUP BY clip_id) UNION ALL SELECT tp.* FROM gr JOIN tp ON tp.clip_id = gr.clip_id AND tp.frame = gr.next),
    rg AS (SELECT gr.clip_id, gr.frame AS start_frame, max(tr.frame) AS end_frame, round(avg(CAST(NOT visible AS INT)), 2) AS dropout_share, round(coalesce(quantile_cont(confidence, 0.5), 0), 2) AS median_confidence FROM gr JOIN tr ON tr.clip_id = gr.clip_id AND tr.frame BETWEEN gr.frame AND until GROUP BY ALL)"""


def register(add) -> None:
    def clicks(get):
        point = lambda dx=0, dy=0: F.struct((F.col("px") + dx).alias("x"), (F.col("py") + dy).alias("y"))
        at = lambda x, y, p: F.max(F.when((F.col("at_x") == x) & (F.col("at_y") == y), p))
        off = F.col("clip_id") % 5
        own, other = F.max(F.when(F.col("user_baseline") == "near", 15.0).otherwise(29.0)).alias("own"), F.max(F.when(F.col("user_baseline") == "near", 29.0).otherwise(15.0)).alias("other")
        rows = get("corners").groupBy("clip_id", "user_baseline").agg(
            own, other, F.array(*[at(x, y, point()) for x, y in ((0, 0), (20, 0), (20, 44), (0, 44))]).alias("corner"),
            *[F.array(at(0, y, point(3 * off, 4 * off)), at(20, y, point())).alias(f"k{y}") for y in (15, 29)])
        pick = lambda which: F.when(F.col(which) == 15, F.col("k15")).otherwise(F.col("k29")).alias(f"{which}_kitchen")
        return rows.select("clip_id", "user_baseline", "corner", pick("own"), F.when(F.col("clip_id") % 2 == 0, pick("other")).alias("other_kitchen"))

    cells = [f"h{k}" for k in K.CELLS]
    qa = lambda get: K.calibration_qa(clicks(get))
    add("g14_calibration_qa", lambda get: qa(get).select("clip_id", *[F.round(c, 9).alias(c) for c in cells], *[F.round(c, 4).alias(c) for c in ("corner_rmse", "own_kitchen_error", "other_kitchen_error", "near_px_per_ft", "far_px_per_ft")], "fault"),
        "w AS (SELECT clip_id, max(CASE WHEN at_x = 0 AND at_y = 0 THEN px END) AS ax, max(CASE WHEN at_x = 0 AND at_y = 0 THEN py END) AS ay, max(CASE WHEN at_x = 20 AND at_y = 0 THEN px END) AS bx, max(CASE WHEN at_x = 20 AND at_y = 0 THEN py END) AS by_, "
        "max(CASE WHEN at_x = 0 AND at_y = 44 THEN px END) AS cx, max(CASE WHEN at_x = 0 AND at_y = 44 THEN py END) AS cy, max(CASE WHEN at_x = 20 AND at_y = 44 THEN px END) AS dx, max(CASE WHEN at_x = 20 AND at_y = 44 THEN py END) AS dy FROM fx_corners GROUP BY clip_id) "
        "SELECT clip_id, " + ", ".join(f"round({c} / h22, 9) AS {c}" for c in cells) + ", CAST(0 AS DOUBLE) AS corner_rmse, CAST(2.5 * (clip_id % 5) AS DOUBLE) AS own_kitchen_error, CAST(CASE WHEN clip_id % 2 = 0 THEN 2.5 * (clip_id % 5) END AS DOUBLE) AS other_kitchen_error, "
        "round(sqrt(power(bx - ax, 2) + power(by_ - ay, 2)) / 20, 4) AS near_px_per_ft, round(sqrt(power(dx - cx, 2) + power(dy - cy, 2)) / 20, 4) AS far_px_per_ft, CAST(NULL AS VARCHAR) AS fault FROM fx_court JOIN w USING (clip_id)")
    add("g14_region_outlines", lambda get: qa(get).select("clip_id", F.explode(F.create_map(*[x for k in ("own_half", "other_half", "own_kitchen_area", "other_kitchen_area") for x in (F.lit(k), F.col(k))])).alias("region", "outline"))
        .select("clip_id", "region", F.posexplode("outline").alias("corner", "p")).select("clip_id", "region", "corner", F.round("p.x", 3).alias("x"), F.round("p.y", 3).alias("y")),
        """u AS (SELECT clip_id, user_baseline = 'near' AS n FROM fx_corners GROUP BY ALL),
    a AS (SELECT clip_id, region, unnest([lo, lo, hi, hi]) AS y, unnest([0, 20, 20, 0]) AS x, unnest([0, 1, 2, 3]) AS corner FROM (SELECT clip_id, unnest(['own_half', 'other_half', 'own_kitchen_area', 'other_kitchen_area']) AS region,
      unnest([CASE WHEN n THEN 0 ELSE 22 END, CASE WHEN n THEN 22 ELSE 0 END, CASE WHEN n THEN 15 ELSE 22 END, CASE WHEN n THEN 22 ELSE 15 END]) AS lo, unnest([CASE WHEN n THEN 22 ELSE 44 END, CASE WHEN n THEN 44 ELSE 22 END, CASE WHEN n THEN 22 ELSE 29 END, CASE WHEN n THEN 29 ELSE 22 END]) AS hi FROM u)),
    m AS (SELECT clip_id, h11*h22 - h12*h21 AS m00, h02*h21 - h01*h22 AS m01, h01*h12 - h02*h11 AS m02, h12*h20 - h10*h22 AS m10, h00*h22 - h02*h20 AS m11, h02*h10 - h00*h12 AS m12, h10*h21 - h11*h20 AS m20, h01*h20 - h00*h21 AS m21, h00*h11 - h01*h10 AS m22 FROM fx_court)
    SELECT clip_id, region, corner, round((m00 * x + m01 * y + m02) / (m20 * x + m21 * y + m22), 3) AS x, round((m10 * x + m11 * y + m12) / (m20 * x + m21 * y + m22), 3) AS y FROM a JOIN m USING (clip_id)""")

    ranges = lambda get: O.troubled_ranges(get("ball"), get("labels").filter("frame < 400"), get("court"))
    add("e14_troubled_ranges", ranges, _RANGES + """ SELECT clip_id, start_frame, end_frame, round((end_frame - start_frame) / fps, 2) AS seconds, CAST(floor((end_frame - start_frame) / 3) AS BIGINT) + 1 AS n_labels, dropout_share, median_confidence, dropout_share > 0.98 AS likely_absent
    FROM rg JOIN fx_court USING (clip_id) WHERE (end_frame - start_frame) / fps >= 0.5""")
    add("e14_propose_labels", lambda get: O.propose_labels(ranges(get), get("court"), 200))

    def pairs(get):
        w = Window.partitionBy("clip_id").orderBy("frame", "shot_id")
        return get("shots").select("clip_id", "hitter_side", "frame", F.lag(F.struct("hitter_side", "frame")).over(w).alias("p")).filter("p.hitter_side = hitter_side").select("clip_id", F.col("hitter_side").alias("side"), F.col("p.frame").alias("from"), F.col("frame").alias("to"))

    add("d6_net_crossings", lambda get: C.crossings(pairs(get), get("ball_3d")), """p AS (SELECT clip_id, hitter_side AS side, lag(hitter_side) OVER w AS b, lag(frame) OVER w AS "from", frame AS "to" FROM fx_shots WINDOW w AS (PARTITION BY clip_id ORDER BY frame, shot_id)),
    f AS (SELECT clip_id, frame, CASE WHEN y >= 27 THEN 'near' WHEN y <= 17 THEN 'far' END AS side FROM fx_ball_3d), i AS (SELECT *, frame - row_number() OVER (PARTITION BY clip_id, side ORDER BY frame) AS k FROM f WHERE side IS NOT NULL),
    s AS (SELECT clip_id, side, min(frame) AS a, max(frame) AS z FROM i GROUP BY clip_id, side, k) SELECT DISTINCT p.clip_id, p.side, p."from", p."to" FROM p JOIN s ON s.clip_id = p.clip_id AND s.side = p.side AND p.side = p.b AND least(z, p."to") - greatest(a, p."from") + 1 >= 10""")

    def stats(get):
        court = get("court").withColumn("real", F.col("clip_id") % 4 != 0)
        return C.rejection_stats(*C.detect_steps(get("ball"), get("chasers"), court, ball_3d=get("ball_3d")))

    add("d12_rejection_stats", stats)
