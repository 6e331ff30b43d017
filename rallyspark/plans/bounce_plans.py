"""Queries on bounces from smoothed and from reconstructed series, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bounces as B
from ..operators.params import scaled_params

_W = "PARTITION BY clip_id ORDER BY frame"
_SERIES = f"""pm AS (SELECT clip_id, greatest(1, CAST(round_even(6 * fps / 30, 0) AS INT)) AS iw, greatest(1, CAST(round_even(3 * fps / 30, 0) AS INT)) AS vw, 9.0E0 * frame_width / 1920 AS prom, 0.3E0 * frame_width / 1920 AS floor_ FROM fx_court),
    kn AS (SELECT clip_id, frame, visible OR interpolated AS known, pixel_y AS y, max(CASE WHEN visible OR interpolated THEN frame END) OVER ({_W}) AS pf, min(CASE WHEN visible OR interpolated THEN frame END) OVER ({_W} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nf FROM fx_ball),
    fi AS (SELECT kn.clip_id, kn.frame, kn.known, CASE WHEN kn.known THEN kn.y WHEN pf IS NULL THEN b.pixel_y WHEN nf IS NULL THEN a.pixel_y ELSE a.pixel_y + (b.pixel_y - a.pixel_y) * (kn.frame - pf) / (nf - pf) END AS f FROM kn
      LEFT JOIN fx_ball a ON a.clip_id = kn.clip_id AND a.frame = pf LEFT JOIN fx_ball b ON b.clip_id = kn.clip_id AND b.frame = nf),
    ys AS (SELECT fi.clip_id, frame, known, iw, vw, prom, floor_, (coalesce(lag(f) OVER w, 0) + f + coalesce(lead(f) OVER w, 0)) / 3 AS ys FROM fi JOIN pm USING (clip_id) WINDOW w AS (PARTITION BY fi.clip_id ORDER BY frame))"""


def register(add) -> None:
    series = lambda get: B.smoothed(get("ball"), scaled_params(get("court")))
    add("n1_smoothed_candidates", lambda get: B.candidates(series(get)).withColumn("score", F.round("score", 6)), _SERIES + f""", wi AS (SELECT *, max(ys) OVER ({_W} RANGE BETWEEN iw PRECEDING AND iw FOLLOWING) AS top, min(ys) OVER ({_W} RANGE BETWEEN iw PRECEDING AND 1 PRECEDING) AS b, min(ys) OVER ({_W} RANGE BETWEEN 1 FOLLOWING AND iw FOLLOWING) AS a,
      max(CAST(known AS INT)) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near, min(frame) OVER (PARTITION BY clip_id) AS lo, max(frame) OVER (PARTITION BY clip_id) AS hi FROM ys)
    SELECT clip_id, frame, round(least(ys - b, ys - a), 6) AS score FROM wi WHERE frame - lo >= iw AND hi - frame >= iw AND ys >= top - 1e-9 AND ys - b >= prom AND ys - a >= prom AND near = 1""")
    add("n4_flips", lambda get: B.flips(series(get)), _SERIES + f""", wi AS (SELECT *, first(frame) OVER b AS f0, first(ys) OVER b AS y0, last(frame) OVER a AS f1, last(ys) OVER a AS y1 FROM ys WINDOW b AS ({_W} RANGE BETWEEN vw PRECEDING AND CURRENT ROW), a AS ({_W} RANGE BETWEEN CURRENT ROW AND vw FOLLOWING))
    SELECT clip_id, frame, CASE WHEN f0 < frame AND frame < f1 THEN (ys - y0) / (frame - f0) > floor_ AND (y1 - ys) / (f1 - frame) < -floor_ END AS flip FROM wi""")
    add("n6_detect_bounces", lambda get: B.detect_bounces(get("ball"), get("chasers"), get("shots").select("clip_id", "frame", "shot_id"), get("scene_court")))
    add("n10_bounces_from_height", lambda get: B.bounces_from_height(get("ball_3d"), get("court")), f"""c AS (SELECT *, max(z) OVER (w ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS ub, max(z) OVER (w ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING) AS ua, count(*) OVER (w ROWS BETWEEN 15 PRECEDING AND 1 PRECEDING) AS nb, count(*) OVER (w ROWS BETWEEN 1 FOLLOWING AND 15 FOLLOWING) AS na, lag(z) OVER w AS z0, lead(z) OVER w AS z1
      FROM fx_ball_3d WINDOW w AS ({_W})),
    t AS (SELECT c.clip_id, frame, frame / fps AS s, x AS court_x_ft, y AS court_y_ft, z AS z_ft FROM c JOIN fx_court USING (clip_id) WHERE z <= 0.35 AND z <= z0 AND z <= z1 AND ub >= 1.0 AND ua >= 0.5 AND nb = 15 AND na = 15),
    p AS (SELECT t.clip_id, t.frame, n.frame AS next FROM t ASOF LEFT JOIN t n ON n.clip_id = t.clip_id AND n.s > t.s + 0.30),
    k(clip_id, frame, next) AS (SELECT clip_id, frame, next FROM p WHERE (clip_id, frame) IN (SELECT (clip_id, min(frame)) FROM t GROUP BY clip_id) UNION ALL SELECT p.clip_id, p.frame, p.next FROM k JOIN p ON p.clip_id = k.clip_id AND p.frame = k.next)
    SELECT t.clip_id, t.frame, court_x_ft, court_y_ft, z_ft FROM t JOIN k ON k.clip_id = t.clip_id AND k.frame = t.frame""")
