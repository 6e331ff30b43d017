"""Queries on report blocks and their confidence, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import rallies as R
from ..operators import report as P

_FEATURES = """pq AS (SELECT *, CASE WHEN pk % 7 <> 0 THEN CAST(pk % 61 - 20 AS DOUBLE) / 20 END AS contact_front, CASE WHEN pk % 5 <> 0 THEN CAST(180 - pk % 60 AS DOUBLE) END AS knee_angle, CASE pk % 3 WHEN 0 THEN 'kitchen' WHEN 1 THEN 'transition' ELSE 'baseline' END AS contact_zone FROM fx_played)"""
_SHRINK = "CASE WHEN {n} > 0 THEN {n} / ({n} + 8) ELSE 0 END"


def _conf(base: str, n: str, factor: str = "1") -> str:
    return f"round(coalesce({base}, 0) * {_SHRINK.format(n=n)} * {factor}, 9)"


def register(add, played, rallies_sql: str) -> None:
    """``played(get)`` gives shots, linked bounces and courts; ``rallies_sql`` are CTEs up to pf, the rallies of those shots."""
    def shots(get):
        return get("played").withColumns({"contact_front": F.expr("CASE WHEN pk % 7 <> 0 THEN CAST(pk % 61 - 20 AS DOUBLE) / 20 END"), "knee_angle": F.expr("CASE WHEN pk % 5 <> 0 THEN CAST(180 - pk % 60 AS DOUBLE) END"), "contact_zone": F.expr("CASE pk % 3 WHEN 0 THEN 'kitchen' WHEN 1 THEN 'transition' ELSE 'baseline' END")})

    rallies = lambda get: R.rallies_of(*played(get))
    owners = lambda get: P.error_owners(rallies(get), get("played"), get("roles"))
    rc = "rc AS (SELECT clip_id, role, round(avg(role_confidence), 6) AS rc FROM fx_roles WHERE role <> 'noise' GROUP BY ALL), pl AS (SELECT clip_id, track_id, role FROM fx_roles WHERE role <> 'noise')"
    eo = rallies_sql + ", " + rc + """,
    e1 AS (SELECT pf.clip_id, rally_id, end_reason, end_confidence, s.role AS server_role, h.role AS hitter_role, z.h AS side FROM pf LEFT JOIN pl s ON s.clip_id = pf.clip_id AND s.track_id = a.t LEFT JOIN fx_played q ON q.clip_id = pf.clip_id AND q.shot_id = z.i LEFT JOIN pl h ON h.clip_id = pf.clip_id AND h.track_id = q.track_id),
    e2 AS (SELECT *, CASE WHEN end_reason = 'serve-fault' THEN coalesce(server_role, 'unattributed') WHEN end_reason IN ('ball-out', 'net-or-short', 'ball-off-frame') THEN coalesce(hitter_role, 'unattributed') WHEN end_reason IN ('double-bounce', 'ball-not-returned') THEN CASE side WHEN 'near' THEN 'team_far' WHEN 'far' THEN 'team_near' ELSE 'unknown' END ELSE 'unknown' END AS owner,
      CASE WHEN end_reason = 'serve-fault' THEN 'server' WHEN end_reason IN ('ball-out', 'net-or-short', 'ball-off-frame') THEN 'hitter' WHEN end_reason IN ('double-bounce', 'ball-not-returned') THEN 'receiver' ELSE 'unknown' END AS kind FROM e1),
    eo AS (SELECT e2.*, end_confidence * coalesce(rc, 1) AS confidence FROM e2 LEFT JOIN rc ON rc.clip_id = e2.clip_id AND rc.role = owner)"""
    add("m9_error_owners", lambda get: owners(get).withColumn("confidence", F.round("confidence", 6)), eo + " SELECT clip_id, rally_id, end_reason, end_confidence, server_role, owner, kind, round(confidence, 6) AS confidence FROM eo")
    add("m9_errors_by_owner", lambda get: P.errors_by_owner(owners(get)).withColumn("attribution_confidence", F.round("attribution_confidence", 9)), eo + f""", w AS (SELECT clip_id, {_conf('avg(confidence)', 'count(*)')} AS attribution_confidence, CASE WHEN {_SHRINK.format(n='count(*)')} <= avg(confidence) THEN 'sample_size' ELSE 'measurement' END AS limited_by FROM eo GROUP BY clip_id)
    SELECT eo.clip_id, end_reason, owner, kind, count(*) AS n, any_value(attribution_confidence) AS attribution_confidence, any_value(limited_by) AS limited_by FROM eo JOIN w USING (clip_id) GROUP BY eo.clip_id, end_reason, owner, kind""")
    flat = lambda df: df.select("clip_id", "role", F.col("shots.value").alias("shots"), F.col("returns.value").alias("returns"), "serve.value.*", F.round("serve.confidence", 9).alias("serve_confidence"), F.col("errors.value").alias("errors"), F.round("errors.confidence", 9).alias("errors_confidence"), F.col("errors.limited_by").alias("errors_limited_by"))
    add("m19_player_report", lambda get: flat(P.player_report(owners(get), get("played"), rallies(get), get("roles"))), eo + f""", j AS (SELECT q.*, role FROM fx_played q JOIN pl ON pl.clip_id = q.clip_id AND pl.track_id = q.track_id), n AS (SELECT clip_id, role, count(*) AS shots, count_if(is_serve) AS serves FROM j GROUP BY ALL),
    b AS (SELECT j.clip_id, role, count(*) AS returns FROM pf JOIN j ON j.clip_id = pf.clip_id AND j.shot_id = pf.shot_ids[2] GROUP BY ALL), s AS (SELECT clip_id, server_role AS role, count_if(end_reason = 'serve-fault') AS faults, avg(end_confidence) AS sc FROM eo GROUP BY ALL), r AS (SELECT clip_id, owner AS role, count(*) AS errors, avg(end_confidence) AS ec FROM eo GROUP BY ALL),
    x AS (SELECT rc.clip_id, rc.role, rc, coalesce(shots, 0) AS shots, coalesce(returns, 0) AS returns, coalesce(serves, 0) AS serves, coalesce(faults, 0) AS faults, sc, coalesce(errors, 0) AS errors, ec FROM rc LEFT JOIN n USING (clip_id, role) LEFT JOIN b USING (clip_id, role) LEFT JOIN s USING (clip_id, role) LEFT JOIN r USING (clip_id, role))
    SELECT clip_id, role, shots, returns, serves, faults, round(coalesce(faults / nullif(serves, 0), 0), 4) AS fault_rate, {_conf('sc', 'serves', 'rc')} AS serve_confidence, errors, {_conf('ec', 'errors', 'rc')} AS errors_confidence, CASE WHEN {_SHRINK.format(n='errors')} <= coalesce(ec, 0) THEN 'sample_size' ELSE 'measurement' END AS errors_limited_by FROM x""")
    bands = " ".join(f"WHEN '{k}' THEN 180 - knee_angle BETWEEN {a} AND {b}" for k, (a, b) in P.KNEE_BANDS.items())
    scope = [("contact", "'all'", "contact_front", "contact_front > 0", "true"), ("contact", "stroke_side", "contact_front", "contact_front > 0", "stroke_side IN ('forehand', 'backhand')"), ("knees", "'all'", "180 - knee_angle", "ok", "true"), ("knees", "shot_type", "180 - knee_angle", "ok", "shot_type IN ('dink', 'serve')"),
             ("knees", "'drive ' || stroke_side", "180 - knee_angle", "ok", "shot_type = 'drive' AND stroke_side IN ('forehand', 'backhand')")]
    long = " UNION ALL ".join(f"SELECT clip_id, role, '{w}' AS what, {s} AS scope, CAST({v} AS DOUBLE) AS v, {ok} AS good FROM q WHERE {v} IS NOT NULL AND {t}" for w, s, v, ok, t in scope)
    add("m6_technique_report", lambda get: P.technique_report(shots(get), get("roles")), _FEATURES + ", " + rc + f""", q AS (SELECT pq.*, role, coalesce(CASE shot_type {bands} END, false) AS ok FROM pq LEFT JOIN pl ON pl.clip_id = pq.clip_id AND pl.track_id = pq.track_id), l AS ({long})
    SELECT clip_id, role, what, scope, count(*) AS n, count_if(good) AS good, round(count_if(good) / count(*), 2) AS share, round(avg(v), 2) AS mean FROM (SELECT * REPLACE (NULL AS role) FROM l UNION ALL SELECT * FROM l WHERE role IS NOT NULL) GROUP BY ALL""")
    add("m7_third_shot_report", lambda get: P.third_shot_report(rallies(get), shots(get), get("roles")).withColumn("confidence", F.round("confidence", 9)), rallies_sql + ", " + _FEATURES + ", " + rc + f""", t AS (SELECT pq.clip_id, role, shot_type, confidence FROM pf JOIN pq ON pq.clip_id = pf.clip_id AND pq.shot_id = pf.shot_ids[3] AND n_shots >= 3 LEFT JOIN pl ON pl.clip_id = pq.clip_id AND pl.track_id = pq.track_id WHERE NOT is_serve AND shot_type IN ('drop', 'drive') AND contact_zone <> 'kitchen')
    SELECT clip_id, role, count(*) AS n, count_if(shot_type = 'drop') AS drops, count_if(shot_type = 'drive') AS drives, round(count_if(shot_type = 'drop') / count(*), 3) AS drop_rate, {_conf('avg(confidence)', 'count(*)')} AS confidence, CASE WHEN {_SHRINK.format(n='count(*)')} <= avg(confidence) THEN 'sample_size' ELSE 'measurement' END AS limited_by
    FROM (SELECT * REPLACE (NULL AS role) FROM t UNION ALL SELECT * FROM t WHERE role IS NOT NULL) GROUP BY clip_id, role""")
