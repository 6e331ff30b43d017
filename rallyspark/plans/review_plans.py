"""Queries on gates, identity, ratings in words and truth, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import helpers as H
from ..operators import metrics as M
from ..operators import review as V
from ..operators import shots as D

_KNOWN = "(visible OR interpolated)"
_W = "PARTITION BY clip_id ORDER BY frame"
_RUN = f"""kn AS (SELECT clip_id, frame, pixel_x AS x, pixel_y AS y, lag(frame) OVER w AS pf, lag(pixel_x) OVER w AS px, lag(pixel_y) OVER w AS py, lead(frame) OVER w AS nf, lead(pixel_x) OVER w AS nx, lead(pixel_y) OVER w AS ny FROM fx_ball WHERE {_KNOWN} WINDOW w AS ({_W})),
    kr AS (SELECT *, sum(CASE WHEN coalesce(frame - pf > 1, true) THEN 1 ELSE 0 END) OVER ({_W}) AS run, sqrt((x-px)*(x-px) + (y-py)*(y-py)) / (frame - pf) AS step, sqrt((nx-x)*(nx-x) + (ny-y)*(ny-y)) / (nf - frame) AS launch FROM kn),
    kl AS (SELECT *, count(*) OVER (PARTITION BY clip_id, run) AS run_length, max(CASE WHEN coalesce(frame - pf > 1, true) THEN coalesce(step, 0) END) OVER (PARTITION BY clip_id, run) AS jump FROM kr)"""


def _near(table: str, extra: str = "") -> str:
    return f"SELECT DISTINCT clip_id, unnest(range(frame - 6, frame + 7)) AS frame, true AS hit FROM {table}{extra}"


def register(add, scores: str, signals: str, scored) -> None:
    """``scores`` and ``signals`` are the CTEs of category scores and of venue signals; ``scored`` makes the former."""
    rated = lambda get: V.category_confidence(scored(get), get("court").select("clip_id", (F.col("clip_id") % 4 == 0).alias("synthetic")))
    own = "CASE WHEN clip_id % 4 = 0 AND category <> 'strategy' THEN confidence * 0.35 ELSE confidence END"
    cap = "CASE WHEN category NOT IN ('forehand', 'backhand') THEN 1.0E0 WHEN level = 3.0 THEN 0.05E0 ELSE 0.30E0 END"
    rt = scores + f""", cc AS (SELECT clip_id, role, category, level, weight, CAST(least({own}, {cap}) AS DOUBLE) AS confidence, CASE WHEN {own} <= {cap} THEN CASE WHEN clip_id % 4 = 0 AND category <> 'strategy' THEN 'synthetic ball' ELSE 'sample size' END ELSE 'stroke reads' END AS limiter, clip_id % 4 = 0 AS synthetic FROM sc),
    ra AS (SELECT *, CASE WHEN confidence >= 0.5 THEN 'real' WHEN confidence >= 0.1 THEN 'partial' ELSE 'uncovered' END AS coverage FROM cc)"""
    add("q3_category_confidence", lambda get: rated(get).select("clip_id", "role", "category", "confidence", "limiter", "coverage"), rt + " SELECT clip_id, role, category, confidence, limiter, coverage FROM ra")
    lst = lambda s: f"coalesce(string_agg(DISTINCT CASE WHEN coverage = '{s}' THEN category END, ',' ORDER BY CASE WHEN coverage = '{s}' THEN category END), '')"
    add("q5_coverage_summary", lambda get: V.coverage_summary(rated(get)), rt + f""" SELECT clip_id, role, CAST(round(sum(CASE WHEN coverage = 'real' THEN weight ELSE 0 END), 6) AS DOUBLE) AS real_weight, CAST(round(sum(CASE WHEN synthetic THEN weight ELSE 0 END), 6) AS DOUBLE) AS synthetic_weight,
      {lst('real')} AS real_categories, {lst('partial')} AS partial_categories FROM ra GROUP BY clip_id, role""")
    values = ", ".join(f"('{c}', '{d}', {u})" for c, d, u in V.DRILLS)
    add("l2_drills", lambda get: V.drills(rated(get)), rt + f""" SELECT clip_id, role, category, place, drill, category || ' is ' || CASE WHEN level < 2.5 THEN 'weak' WHEN level < 3.5 THEN 'developing' ELSE 'sound' END AS finding FROM (
      SELECT *, row_number() OVER (PARTITION BY clip_id, role, category ORDER BY upto) AS place FROM (SELECT * REPLACE (round(level, 6) AS level) FROM ra) JOIN (VALUES {values}) AS d(category, drill, upto) USING (category) WHERE level < upto) WHERE place <= 2""")
    add("l3_operator_notes", lambda get: V.operator_notes(rated(get)), rt + " SELECT clip_id, limiter, string_agg(DISTINCT category, ',' ORDER BY category) AS affected, count(*) AS n FROM ra WHERE NOT synthetic AND confidence < 0.6 GROUP BY clip_id, limiter")
    add("l4_next_target", lambda get: V.next_target(rated(get).groupBy("clip_id", "role").agg(F.round(F.avg("level"), 6).alias("rating"))), rt + " SELECT clip_id, role, CAST(least(floor(round(avg(level), 6) * 2) / 2 + 0.5, 5.0) AS DOUBLE) AS target FROM ra GROUP BY clip_id, role")
    add("d4_contamination_gates", lambda get: V.contamination_gates(get("shots"), get("ball")), _RUN + """, mj AS (SELECT s.clip_id, s.shot_id, max(step) AS far FROM fx_shots s JOIN kr ON kr.clip_id = s.clip_id AND pf >= s.frame - 30 AND kr.frame <= s.frame + 30 GROUP BY ALL)
    SELECT s.clip_id, s.shot_id, run_length, CASE WHEN jump > 40 AND run_length < 8 THEN 'blip' WHEN far >= 60 THEN 'latch' ELSE 'kept' END AS reason FROM fx_shots s JOIN kl ON kl.clip_id = s.clip_id AND kl.frame = s.frame LEFT JOIN mj ON mj.clip_id = s.clip_id AND mj.shot_id = s.shot_id""")
    add("d7_serve_appearances", lambda get: V.serve_appearances(get("ball")), _RUN + " SELECT clip_id, frame, launch, run_length FROM kl WHERE (pf IS NULL OR frame - pf - 1 >= 3) AND launch >= 5 AND run_length >= 4")
    add("d10_drop_ground_balls", lambda get: V.drop_ground_balls(get("shots"), get("ball"), get("court")), f"""p AS (SELECT clip_id, frame, (h00*pixel_x + h01*pixel_y + h02) / (h20*pixel_x + h21*pixel_y + h22) AS x, (h10*pixel_x + h11*pixel_y + h12) / (h20*pixel_x + h21*pixel_y + h22) AS y, {_KNOWN} AS known FROM fx_ball JOIN fx_court USING (clip_id)),
    g AS (SELECT clip_id, frame, CASE WHEN known THEN CASE WHEN x BETWEEN -8 AND 28 AND y BETWEEN -8 AND 52 THEN 1 ELSE 0 END END AS v FROM p), f AS (SELECT clip_id, frame, CASE WHEN count(v) OVER w >= 6 THEN avg(v) OVER w END AS grounded FROM g WINDOW w AS ({_W} RANGE BETWEEN 15 PRECEDING AND 15 FOLLOWING))
    SELECT s.clip_id, shot_id, grounded FROM fx_shots s LEFT JOIN f ON f.clip_id = s.clip_id AND f.frame = s.frame WHERE coalesce(grounded < 0.7, true)""")
    box = "sqrt(power(greatest(bbox_x1 - {x}, 0, {x} - bbox_x2), 2) + power(greatest(bbox_y1 - {y}, 0, {y} - bbox_y2), 2))"
    add("n4_at_feet_and_flip", lambda get: V.at_feet_and_flip(D.bounce_candidates(get("ball")).select("clip_id", "frame"), get("ball"), get("players")), f"""s AS (SELECT clip_id, frame, pixel_x, pixel_y, pixel_y - lag(pixel_y, 3) OVER w AS fall, lead(pixel_y, 3) OVER w - pixel_y AS rise, count(CASE WHEN {_KNOWN} THEN 1 END) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS nk,
      max(pixel_y) OVER (w ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS top, min(pixel_y) OVER (w ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS bf, min(pixel_y) OVER (w ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS af FROM fx_ball WINDOW w AS ({_W})),
    n AS (SELECT s.clip_id, s.frame, fall, rise, min({{'d': {box.format(x='pixel_x', y='pixel_y')}, 'r': least(greatest(0.5 * (bbox_y2 - bbox_y1), 30), 400)}}) FILTER (WHERE track_id IS NOT NULL) AS b FROM s LEFT JOIN (SELECT * FROM fx_players WHERE NOT transient) p ON p.clip_id = s.clip_id AND p.frame = s.frame
      WHERE pixel_y = top AND pixel_y - bf >= 30 AND pixel_y - af >= 30 AND nk > 0 GROUP BY s.clip_id, s.frame, fall, rise) SELECT clip_id, frame, coalesce(b.d <= b.r, false) AS at_feet, coalesce(fall > 0 AND rise < 0, false) AS flip FROM n""")
    clicks = lambda get: get("contacts").filter("part = 'hitter'").select("clip_id", "frame", F.col("shot_id").alias("click_id"), F.col("impact_x").alias("click_x"), (F.col("impact_y") - F.when(F.col("n") % 9 == 0, 500).otherwise(0)).alias("click_y"))
    add("p4_resolve_clicks", lambda get: V.resolve_clicks(clicks(get), get("contacts")), f"""c AS (SELECT clip_id, frame, shot_id AS click_id, impact_x AS cx, impact_y - CASE WHEN n % 9 = 0 THEN 500 ELSE 0 END AS cy FROM fx_contacts WHERE part = 'hitter'),
    b AS (SELECT c.clip_id, click_id, min({{'d': {box.format(x='cx', y='cy')}, 't': track_id}}) AS b FROM c JOIN fx_contacts p ON p.clip_id = c.clip_id AND p.frame = c.frame GROUP BY ALL)
    SELECT clip_id, click_id, CASE WHEN b.d <= 150 THEN b.t END AS track_id, round(b.d, 4) AS distance, CASE WHEN b.d > 150 THEN 'too far' END AS error FROM b""")
    add("p10_track_similarity", lambda get: V.track_similarity(get("tracks")), """a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY n_rows DESC, track_id) AS k FROM fx_tracks) WHERE k = 1),
    j AS (SELECT t.clip_id, t.track_id, a.track_id AS anchor_id, list_cosine_similarity(CAST(t.signature AS DOUBLE[]), CAST(a.signature AS DOUBLE[])) AS look, greatest(0, 1 - abs(t.height - a.height) / 0.9) AS tall, t.first_frame - a.last_frame AS gap, sqrt(power(t.first_x - a.last_x, 2) + power(t.first_y - a.last_y, 2)) AS far
      FROM fx_tracks t JOIN a ON a.clip_id = t.clip_id AND a.track_id <> t.track_id), f AS (SELECT *, CASE WHEN gap BETWEEN 0 AND 240 AND far <= 12 THEN (1 - gap / 240) * (1 - far / 12) ELSE 0 END AS follows FROM j)
    SELECT clip_id, track_id, anchor_id, CAST(round(CASE WHEN look IS NULL THEN 0.6 * tall + 0.4 * follows ELSE 0.60 * look + 0.25 * tall + 0.15 * follows END, 5) AS DOUBLE) AS score FROM f""")
    add("m1_rally_shots", lambda get: V.rally_shots(get("shots"), get("rallies").filter("n_shots >= 3 and clip_id % 5 <> 0")), """r AS (SELECT clip_id, rally_id FROM fx_rallies WHERE n_shots >= 3 AND clip_id % 5 <> 0)
    SELECT clip_id, shot_id, rally_no FROM fx_shots s WHERE EXISTS (SELECT 1 FROM r WHERE r.clip_id = s.clip_id AND r.rally_id = s.rally_no) OR s.clip_id NOT IN (SELECT clip_id FROM r)""")
    add("m2_role_maps", lambda get: V.role_maps(get("roles")), "SELECT clip_id, role, count(*) AS tracks, round(avg(role_confidence), 6) AS confidence, round(avg(role_confidence), 6) < 0.55 AS contaminated FROM fx_roles WHERE role <> 'noise' GROUP BY clip_id, role")
    add("e7_recall_census", lambda get: V.recall_census(get("truth"), get("ball"), get("shots")), """s AS (SELECT t.clip_id, truth_id, count(*) AS n, max(confidence) AS best FROM fx_truth t JOIN fx_ball b ON b.clip_id = t.clip_id AND b.frame BETWEEN t.frame - 60 AND t.frame + 60 WHERE visible GROUP BY ALL),
    x AS (SELECT DISTINCT clip_id, unnest(range(frame - 60, frame + 61)) AS frame FROM fx_shots) SELECT t.clip_id, t.truth_id, coalesce(n, 0) AS visible_frames, best, CASE WHEN x.frame IS NOT NULL THEN 'ok' WHEN n >= 6 THEN 'algorithm' ELSE 'detector' END AS cause
    FROM fx_truth t LEFT JOIN s ON s.clip_id = t.clip_id AND s.truth_id = t.truth_id LEFT JOIN x ON x.clip_id = t.clip_id AND x.frame = t.frame""")
    add("e10_label_audit", lambda get: V.label_audit(get("ball"), get("labels")), """j AS (SELECT l.clip_id, confidence, sqrt(power(pixel_x - label_x, 2) + power(pixel_y - label_y, 2)) * 0.5 AS d FROM fx_labels l JOIN fx_ball b ON b.clip_id = l.clip_id AND b.frame = l.frame WHERE ball_visible AND visible)
    SELECT clip_id, count(*) AS n, quantile_cont(d, 0.5) AS median_px, avg(CAST(d <= 6 AS INT)) AS close_share, avg(CAST(d > 20 AND confidence >= 0.5 AS INT)) AS bad_share FROM j GROUP BY clip_id""")
    add("e13_venue_table", lambda get: V.venue_table(E.venue_signals(get("ball"))), signals + " SELECT clip_id % 4 AS venue, count(*) AS clips, avg(det_rate) AS det_rate, avg(mean_conf) AS mean_conf, avg(p90_conf) AS p90_conf FROM si GROUP BY clip_id % 4")
    rank = lambda c: f"(SELECT count(*) FROM si b WHERE b.{c} < a.{c}) + ((SELECT count(*) FROM si b WHERE b.{c} = a.{c}) + 1) / 2"
    add("e13_rank_agreement", lambda get: V.rank_agreement(E.venue_signals(get("ball"))), signals + f" SELECT count(*) AS clips, round(corr(x, y), 9) AS spearman FROM (SELECT {rank('det_rate')} AS x, {rank('p90_conf')} AS y FROM si a)")
    add("e15_remap_labels", lambda get: V.remap_labels(get("labels"), get("ball").filter("frame % 13 = 5").select("clip_id", "frame", (F.col("frame") % 5 - 2).alias("shift"))), f"""d AS (SELECT clip_id, frame AS df, frame % 5 - 2 AS shift FROM fx_ball WHERE frame % 13 = 5),
    j AS (SELECT l.*, coalesce(shift, 0) AS shift, row_number() OVER (PARTITION BY l.clip_id, l.frame ORDER BY abs(df - l.frame), df) AS k FROM fx_labels l LEFT JOIN d ON d.clip_id = l.clip_id AND abs(df - l.frame) <= 13),
    m AS (SELECT clip_id, frame + shift AS frame, frame AS old_frame, ball_visible, label_x, label_y, row_number() OVER (PARTITION BY clip_id, frame + shift ORDER BY frame) AS place FROM j WHERE k = 1) SELECT clip_id, frame, old_frame, ball_visible, label_x, label_y FROM m WHERE place = 1""")
    add("e17_training_manifest", lambda get: V.training_manifest(get("labels")), """SELECT clip_id, frame - 1 AS first_frame, frame + 1 AS last_frame, label_x * 0.25E0 AS x, label_y * 0.25E0 AS y, coalesce(label_x * 0.25E0 BETWEEN 0 AND 480 AND label_y * 0.25E0 BETWEEN 0 AND 270, NOT ball_visible) AS in_bounds,
      CASE WHEN clip_id = 0 THEN 'holdout' ELSE 'train' END AS split FROM fx_labels WHERE frame >= 1""")
    add("e19_in_play_bound", lambda get: V.in_play_bound(get("bounces"), get("rallies")), """i AS (SELECT b.clip_id, EXISTS (SELECT 1 FROM fx_rallies r WHERE r.clip_id = b.clip_id AND b.frame BETWEEN start_frame AND end_frame) AS ok FROM fx_bounces b)
    SELECT clip_id, inside, outside, shots, inside <= shots AS within_bound FROM (SELECT clip_id, count_if(ok) AS inside, count_if(NOT ok) AS outside FROM i GROUP BY clip_id) JOIN (SELECT clip_id, CAST(sum(n_shots) AS BIGINT) AS shots FROM fx_rallies GROUP BY clip_id) USING (clip_id)""")
    add("e22_impact_report", lambda get: V.impact_report(get("shots"), get("truth")), f"""a AS ({_near('fx_shots')}), b AS ({_near('fx_truth')}),
    r AS (SELECT t.clip_id, CASE WHEN true_type = 'serve' THEN 'serve' ELSE 'other' END AS kind, count(*) AS n_true, count(hit) AS found FROM fx_truth t LEFT JOIN a ON a.clip_id = t.clip_id AND a.frame = t.frame GROUP BY ALL),
    g AS (SELECT s.clip_id, CASE WHEN is_serve THEN 'serve' ELSE 'other' END AS kind, count(*) AS n_got, count(hit) AS "right" FROM fx_shots s LEFT JOIN b ON b.clip_id = s.clip_id AND b.frame = s.frame GROUP BY ALL)
    SELECT *, found / n_true AS recall, "right" / n_got AS precision FROM r JOIN g USING (clip_id, kind)""")
    cols = ["clip_id", "shot_id", "frame", "track_id", "is_serve"]
    add("d9_same_track_repeats", lambda get: H.same_track_repeats(get("shots").select(*cols), 360))
    count = lambda: F.sum((~F.col("is_serve")).cast("long")).over(Window.partitionBy("clip_id").orderBy("frame"))
    add("d8_dedup_serves", lambda get: H.dedup_serves(get("shots").withColumn("upto", count()).filter("is_serve").select("clip_id", "shot_id", "frame", "upto", F.col("upto").alias("before"), (F.col("pk") % 9).cast("long").alias("run_length")), 120))
