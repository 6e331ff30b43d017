"""Queries on collections of clips, seeded label samples and venues, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as E
from ..operators import review as V
from ..operators import shots as D
from ..operators import unions as U
from ..sources.readers import written

_RALLIES = "ur AS (SELECT clip_id, rally_no AS rally_id, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS n_shots, 'unknown' AS end_reason, list(shot_id ORDER BY frame, shot_id) AS shot_ids, arg_min(shot_id, frame) AS serve_shot_id, arg_min(track_id, frame) AS server FROM fx_shots GROUP BY clip_id, rally_no)"
_OFFSETS = _RALLIES + """,
    um AS (SELECT clip_id, clip_id % 8 AS collection_id FROM fx_court), s_ AS (SELECT clip_id, max(shot_id) + 1 AS n FROM fx_shots GROUP BY clip_id), r_ AS (SELECT clip_id, count(*) AS n FROM ur GROUP BY clip_id), b_ AS (SELECT clip_id, max(bounce_id) + 1 AS n FROM fx_bounces GROUP BY clip_id),
    t_ AS (SELECT clip_id, max(track_id) + 1 AS n FROM fx_roles GROUP BY clip_id), f_ AS (SELECT clip_id, max(frame) + 1 AS n FROM (SELECT clip_id, frame FROM fx_shots UNION ALL SELECT clip_id, frame FROM fx_bounces UNION ALL SELECT clip_id, frame FROM fx_players) GROUP BY clip_id),
    e_ AS (SELECT clip_id, (max(frame) - min(frame)) / any_value(fps) AS n FROM (SELECT clip_id, frame FROM fx_shots UNION ALL SELECT clip_id, frame FROM fx_bounces UNION ALL SELECT clip_id, end_frame FROM ur) JOIN fx_court USING (clip_id) GROUP BY clip_id),
    uo AS (SELECT um.collection_id, um.clip_id, row_number() OVER v - 1 AS video_id, """ + ", ".join(f"coalesce(CAST(sum(coalesce({k[0]}_.n, 0)) OVER w AS BIGINT), 0) AS {k}_before" for k in U.IDS) + """, coalesce(e_.n, 0) AS span_sec, coalesce(sum(coalesce(e_.n, 0)) OVER w, 0) AS sec_before
      FROM um LEFT JOIN s_ USING (clip_id) LEFT JOIN r_ USING (clip_id) LEFT JOIN b_ USING (clip_id) LEFT JOIN t_ USING (clip_id) LEFT JOIN f_ USING (clip_id) LEFT JOIN e_ USING (clip_id)
      WINDOW v AS (PARTITION BY um.collection_id ORDER BY um.clip_id), w AS (PARTITION BY um.collection_id ORDER BY um.clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    uf AS (SELECT uo.*, fps FROM uo JOIN fx_court USING (clip_id))"""
_BETWEEN = """, ub AS (SELECT b.clip_id, b.bounce_id, b.frame, [p, n] AS between_ FROM fx_bounces b JOIN (SELECT clip_id, bounce_id, max(CASE WHEN shot_id IS NOT NULL THEN shot_id END) OVER (PARTITION BY clip_id ORDER BY frame RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p,
      min(CASE WHEN shot_id IS NOT NULL THEN shot_id END) OVER (PARTITION BY clip_id ORDER BY frame RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS n FROM (SELECT clip_id, frame, bounce_id, CAST(NULL AS BIGINT) AS shot_id FROM fx_bounces UNION ALL SELECT clip_id, frame, CAST(NULL AS BIGINT), shot_id FROM fx_shots)) l ON l.clip_id = b.clip_id AND l.bounce_id = b.bounce_id)"""


def _streams(get):
    """(members, the five streams and the courts) of the stand-in clips: collections are clip numbers modulo 8."""
    shots = get("shots", again=True)
    at = F.struct("frame", "shot_id")
    rallies = shots.groupBy("clip_id", F.col("rally_no").alias("rally_id")).agg(F.min("frame").alias("start_frame"), F.max("frame").alias("end_frame"), F.count("*").alias("n_shots"), F.lit("unknown").alias("end_reason"),
                                                                                F.transform(F.sort_array(F.collect_list(at)), lambda s: s["shot_id"]).alias("shot_ids"), F.min_by("shot_id", at).alias("serve_shot_id"), F.min_by("track_id", at).alias("server"))
    linked = D.between_shots(get("bounces"), shots).select("clip_id", "bounce_id", "frame", F.array("prev_shot", "next_shot").alias("between"))
    court = get("scene_court")
    return court.select("clip_id", (F.col("clip_id") % 8).alias("collection_id")), shots, rallies, linked, get("players"), get("roles"), court


def register(add) -> None:
    offsets = lambda get: U.all_offsets(*_streams(get))

    def union(get, poses=False):
        members, *streams, court = _streams(get)
        placed = written(U.all_offsets(members, *streams, court))  # one row per member, which every stream meets
        return U.union_all(placed, *streams, court, get("poses") if poses else None)

    add("a1_all_offsets", lambda get: offsets(get).withColumns({c: F.round(c, 6) for c in ("span_sec", "sec_before")}), _OFFSETS + " SELECT * REPLACE (round(span_sec, 6) AS span_sec, round(sec_before, 6) AS sec_before) FROM uo")
    add("a2_union_shots", lambda get: union(get)["shots"].drop("t_sec"), _OFFSETS + " SELECT collection_id, video_id, shot_type, hitter_side, is_serve, shot_id + shots_before AS shot_id, track_id + tracks_before AS track_id, frame AS video_frame, frame + frames_before AS frame FROM fx_shots JOIN uf USING (clip_id)")
    add("a2_union_rallies", lambda get: union(get)["rallies"].drop("start_t_sec", "end_t_sec"), _OFFSETS + """ SELECT collection_id, video_id, n_shots, end_reason, rally_id + rallies_before AS rally_id, [x + shots_before FOR x IN shot_ids] AS shot_ids, serve_shot_id + shots_before AS serve_shot_id, server + tracks_before AS server,
    start_frame + frames_before AS start_frame, end_frame + frames_before AS end_frame FROM ur JOIN uf USING (clip_id)""")
    add("a2_union_bounces", lambda get: union(get)["bounces"].drop("t_sec"), _OFFSETS + _BETWEEN + """ SELECT collection_id, video_id, bounce_id + bounces_before AS bounce_id, [x + shots_before FOR x IN between_] AS "between", frame AS video_frame, frame + frames_before AS frame FROM ub JOIN uf USING (clip_id)""")
    add("a2_union_players", lambda get: union(get)["players"].drop("t_sec"), _OFFSETS + " SELECT collection_id, video_id, court_x_ft, court_y_ft, track_id + tracks_before AS track_id, frame AS video_frame, frame + frames_before AS frame FROM fx_players JOIN uf USING (clip_id)")
    add("a2_union_roles", lambda get: union(get)["roles"], _OFFSETS + " SELECT collection_id, video_id, role_confidence, track_id + tracks_before AS track_id, CASE WHEN role = 'opp_b' THEN 'opp_a' ELSE role END AS role FROM fx_roles JOIN uf USING (clip_id)")
    add("a2_union_poses", lambda get: union(get, True)["poses"].groupBy("collection_id", "video_id").agg(F.count("*").alias("poses"), F.min("frame").alias("first_frame"), F.max("frame").alias("last_frame"), F.count_distinct("track_id").alias("tracks")),
        _OFFSETS + " SELECT collection_id, video_id, count(*) AS poses, min(frame + frames_before) AS first_frame, max(frame + frames_before) AS last_frame, count(DISTINCT track_id) AS tracks FROM fx_poses JOIN uf USING (clip_id) GROUP BY ALL")
    add("a5_check_references", lambda get: U.check_references(union(get)), _OFFSETS + _BETWEEN + """, rr AS (SELECT collection_id, count(*) AS n FROM (SELECT collection_id, unnest(shot_ids) FROM ur JOIN um USING (clip_id)) GROUP BY 1), bb AS (SELECT collection_id, count(x) AS n FROM (SELECT collection_id, unnest(between_) AS x FROM ub JOIN um USING (clip_id)) GROUP BY 1),
    ff AS (SELECT collection_id, count_if(n > 1) AS n FROM (SELECT collection_id, k, clip_id, frame, count(*) AS n FROM (SELECT clip_id, 's' AS k, frame FROM fx_shots UNION ALL SELECT clip_id, 'b', frame FROM fx_bounces) JOIN um USING (clip_id) GROUP BY ALL) GROUP BY 1)
    SELECT collection_id, rr.n AS rallies_refs, bb.n AS bounces_refs, CAST(0 AS BIGINT) AS rallies_dangling, CAST(0 AS BIGINT) AS bounces_dangling, ff.n AS shared_frames, CAST(0 AS BIGINT) AS tracks_without_role FROM rr JOIN bb USING (collection_id) JOIN ff USING (collection_id)""")
    add("a6_provenance", lambda get: (lambda s: U.provenance(offsets(get), s[1], s[2], s[3], s[6]))(_streams(get)), _OFFSETS + """ SELECT collection_id, video_id, clip_id, round(span_sec, 3) AS span_sec, coalesce(n_shots, 0) AS n_shots, coalesce(r_.n, 0) AS n_rallies, coalesce(n_bounces, 0) AS n_bounces, fps, CASE WHEN clip_id % 4 <> 0 THEN 'real' ELSE 'synthetic' END AS ball_source
    FROM uf LEFT JOIN (SELECT clip_id, count(*) AS n_shots FROM fx_shots GROUP BY 1) USING (clip_id) LEFT JOIN r_ USING (clip_id) LEFT JOIN (SELECT clip_id, count(*) AS n_bounces FROM fx_bounces GROUP BY 1) USING (clip_id)""")
    gated = lambda get: get("court").select("clip_id", F.explode(F.expr("CASE clip_id % 5 WHEN 1 THEN array('landing', 'net') WHEN 2 THEN array('speed') END")).alias("metric"))
    add("a6_reliability", lambda get: U.reliability(get("scene_court").select("clip_id", (F.col("clip_id") % 8).alias("collection_id")), get("scene_court"), gated(get)), """m AS (SELECT clip_id, clip_id % 8 AS collection_id, real FROM fx_scene_court),
    g AS (SELECT collection_id, list_sort(list(DISTINCT x)) AS gated FROM (SELECT collection_id, unnest(CASE clip_id % 5 WHEN 1 THEN ['landing', 'net'] WHEN 2 THEN ['speed'] END) AS x FROM m) GROUP BY 1) SELECT collection_id, count(*) AS members, NOT bool_and(real) AS synthetic, coalesce(any_value(gated), []) AS gated FROM m LEFT JOIN g USING (collection_id) GROUP BY collection_id""")

    add("e10_seeded_sample", lambda get: E.sample_labels(get("labels"), 40, 3).select("clip_id", "frame", "label_x", "label_y"), "SELECT clip_id, frame, label_x, label_y FROM fx_labels WHERE ball_visible AND label_x IS NOT NULL QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY md5('3:' || clip_id || ':' || frame), frame) <= 40")
    add("e10_audit_of_sample", lambda get: V.label_audit(get("ball"), E.sample_labels(get("labels"), 40, 3)), """l AS (SELECT * FROM fx_labels WHERE ball_visible AND label_x IS NOT NULL QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY md5('3:' || clip_id || ':' || frame), frame) <= 40),
    j AS (SELECT l.clip_id, confidence, sqrt(power(pixel_x - label_x, 2) + power(pixel_y - label_y, 2)) * 0.5 AS d FROM l JOIN fx_ball b ON b.clip_id = l.clip_id AND b.frame = l.frame WHERE visible)
    SELECT clip_id, count(*) AS n, quantile_cont(d, 0.5) AS median_px, avg(CAST(d <= 6 AS INT)) AS close_share, avg(CAST(d > 20 AND confidence >= 0.5 AS INT)) AS bad_share FROM j GROUP BY clip_id""")
    motion = """st AS (SELECT clip_id, CASE WHEN frame - lag(frame) OVER w = 1 THEN sqrt(power(pixel_x - lag(pixel_x) OVER w, 2) + power(pixel_y - lag(pixel_y) OVER w, 2)) * (1280 / frame_width) END AS step FROM fx_ball JOIN fx_court USING (clip_id) WHERE visible AND confidence >= 0.3 WINDOW w AS (PARTITION BY clip_id ORDER BY frame)),
    mo AS (SELECT clip_id, count(step) AS n_steps, quantile_cont(step, 0.5) AS median_step, avg(CAST(step >= 2 AS INT)) AS moving_share, avg(CAST(step BETWEEN 2 AND 55 AS INT)) AS continuity FROM st GROUP BY clip_id)"""
    add("e11_motion_signals", lambda get: E.motion_signals(get("ball"), get("court")), motion + " SELECT * FROM mo")
    signals = lambda get: E.venue_signals(get("ball")).join(E.motion_signals(get("ball"), get("court")), "clip_id")
    known = lambda get: E.venue_signals(get("ball")).filter("clip_id % 3 = 1").select(F.col("clip_id"), (F.col("p90_conf") - F.col("clip_id") / 50).alias("p90_conf"), "det_rate", (F.col("clip_id") / 20).alias("recall"))
    add("e12_venue_verdicts", lambda get: E.venue_verdicts(signals(get), known(get)), motion + """, si AS (SELECT clip_id, avg(CAST(visible AND confidence >= 0.3 AS INT)) AS det_rate, quantile_cont(CASE WHEN visible AND confidence >= 0.3 THEN confidence END, 0.9) AS p90 FROM fx_ball GROUP BY clip_id),
    k AS (SELECT clip_id AS nearest, p90 - clip_id / 50 AS p90, det_rate, clip_id / 20 AS nearest_recall FROM si WHERE clip_id % 3 = 1),
    v AS (SELECT si.clip_id, CASE WHEN p90 < 0.470 THEN 'faint' WHEN det_rate < 0.182 THEN 'rare' WHEN n_steps >= 20 AND moving_share < 0.20 THEN 'parked' ELSE 'ok' END AS reason, p90, det_rate FROM si JOIN mo USING (clip_id))
    SELECT v.clip_id, CASE WHEN reason = 'ok' THEN 'ok' ELSE 'not_supported' END AS verdict, reason, nearest, nearest_recall FROM v JOIN k ON true QUALIFY row_number() OVER (PARTITION BY v.clip_id ORDER BY abs(k.p90 - v.p90) + abs(k.det_rate - v.det_rate), nearest) = 1""")
