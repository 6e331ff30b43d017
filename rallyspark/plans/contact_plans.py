"""Queries on contacts, poses, flights and sizes, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import poses as S
from ..operators import trajectory as T


def _seen(name: str, floor: float, part: str) -> str:
    return f"CASE WHEN {name}v >= {floor} THEN {name}{part} END"


def _mean(a: str, b: str) -> str:
    return f"coalesce(({a} + {b}) / 2, {a}, {b})"


def _angle(s: str) -> str:
    hip, ankle = ((f"({s}{p}x - {s}kx)", f"({s}{p}y - {s}ky)") for p in "ha")
    dot = f"({hip[0]}*{ankle[0]} + {hip[1]}*{ankle[1]})"
    norm = f"(sqrt({hip[0]}*{hip[0]} + {hip[1]}*{hip[1]}) * sqrt({ankle[0]}*{ankle[0]} + {ankle[1]}*{ankle[1]}))"
    return f"CASE WHEN least({s}hv, {s}kv, {s}av) >= 0.3 THEN degrees(acos(greatest(-1, least(1, {dot} / {norm})))) END"


_COF = ", ".join(f"(h{(j + 1) % 3}{(i + 1) % 3}*h{(j + 2) % 3}{(i + 2) % 3} - h{(j + 1) % 3}{(i + 2) % 3}*h{(j + 2) % 3}{(i + 1) % 3}) AS a{i}{j}" for i in range(3) for j in range(3))
_IMG = "(a{i}0*{x} + a{i}1*{y} + a{i}2) / (a20*{x} + a21*{y} + a22)"
_FEET = """fa AS (SELECT c.clip_id, c.frame, c.track_id, x0, y0, CASE WHEN lav >= 0.3 THEN (h00*lax + h01*lay + h02) / (h20*lax + h21*lay + h22) END AS x1, CASE WHEN lav >= 0.3 THEN (h10*lax + h11*lay + h12) / (h20*lax + h21*lay + h22) END AS y1,
      CASE WHEN rav >= 0.3 THEN (h00*rax + h01*ray + h02) / (h20*rax + h21*ray + h22) END AS x2, CASE WHEN rav >= 0.3 THEN (h10*rax + h11*ray + h12) / (h20*rax + h21*ray + h22) END AS y2
      FROM (SELECT DISTINCT clip_id, frame, track_id, court_x_ft AS x0, court_y_ft AS y0 FROM fx_contacts) c JOIN fx_court USING (clip_id) LEFT JOIN fx_poses p ON p.clip_id = c.clip_id AND p.frame = c.frame AND p.track_id = c.track_id),
    ff AS (SELECT clip_id, frame, track_id, CASE WHEN abs(y0 - 22) = m THEN x0 WHEN abs(y1 - 22) = m THEN x1 ELSE x2 END AS front_x, CASE WHEN abs(y0 - 22) = m THEN y0 WHEN abs(y1 - 22) = m THEN y1 ELSE y2 END AS front_y
      FROM (SELECT *, least(abs(y0 - 22), abs(y1 - 22), abs(y2 - 22)) AS m FROM fa))"""
_LAND = """ld AS (SELECT clip_id, shot_id, land_frame, land_x, land_y FROM (SELECT lk.clip_id, prev_shot AS shot_id, lk.frame AS land_frame, court_x_ft AS land_x, court_y_ft AS land_y, row_number() OVER (PARTITION BY lk.clip_id, prev_shot ORDER BY lk.frame, lk.bounce_id) AS k
      FROM lk JOIN fx_bounces b ON b.clip_id = lk.clip_id AND b.bounce_id = lk.bounce_id WHERE prev_shot IS NOT NULL AND court_y_ft IS NOT NULL) WHERE k = 1)"""
_NEXT = "PARTITION BY clip_id ORDER BY frame, shot_id"


def _end(frame: str, x: str, y: str, kind: str, base: float, extra: str = "") -> str:
    air, far = f"(({frame} - frame) / fps)", f"sqrt(({x} - front_x)*({x} - front_x) + ({y} - front_y)*({y} - front_y))"
    low, high = f"least({y}, front_y)", f"greatest({y}, front_y)"
    return (f"CASE WHEN {frame} IS NOT NULL AND {air} >= 0.1 AND {far} <= 44 AND {low} <= 24 AND {high} >= 20{extra.format(air=air)} THEN {{'anchor': '{kind}', 'speed': {far} / {air}, "
            f"'confidence': {base} * CASE WHEN {low} < -3 OR {high} > 47 THEN 0.5E0 ELSE 1.0E0 END * CASE WHEN {air} < 0.15 THEN 0.5E0 ELSE 1.0E0 END}} END")


def _speed_sql(linked: str) -> str:
    return f"""{linked}, {_LAND}, {_FEET}, at_ AS (SELECT s.clip_id, s.shot_id, s.frame, is_serve, front_x, front_y FROM fx_shots s JOIN ff ON ff.clip_id = s.clip_id AND ff.frame = s.frame AND ff.track_id = s.track_id),
    nx AS (SELECT *, CASE WHEN NOT lead(is_serve) OVER w THEN lead(frame) OVER w END AS nf, lead(front_x) OVER w AS nx, lead(front_y) OVER w AS ny FROM at_ WINDOW w AS ({_NEXT})),
    sp AS (SELECT clip_id, shot_id, b.anchor AS anchor, round(b.speed, 6) AS speed, b.confidence AS confidence FROM (SELECT clip_id, nx.shot_id, coalesce({_end('land_frame', 'land_x', 'land_y', 'bounce', 0.85)}, {_end('nf', 'nx', 'ny', 'contact', 0.6, ' AND {air} <= 1.5')}) AS b
      FROM nx JOIN fx_court USING (clip_id) LEFT JOIN ld USING (clip_id, shot_id)) WHERE b IS NOT NULL)"""


_ARC = f"""fe AS (SELECT clip_id, shot_id, frame, CASE WHEN lead(frame) OVER w - frame <= 90 THEN lead(frame) OVER w - 1 ELSE frame + 90 END AS stop FROM fx_shots WINDOW w AS ({_NEXT})),
    pt AS (SELECT fe.clip_id, shot_id, b.frame, pixel_x AS x, pixel_y AS y FROM fe JOIN fx_ball b ON b.clip_id = fe.clip_id AND b.frame BETWEEN fe.frame AND fe.stop WHERE visible OR interpolated),
    ed AS (SELECT *, first_value(frame) OVER w AS f0, first_value(x) OVER w AS x0, first_value(y) OVER w AS y0, last_value(frame) OVER w AS f1, last_value(x) OVER w AS x1, last_value(y) OVER w AS y1 FROM pt WINDOW w AS (PARTITION BY clip_id, shot_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    ar AS (SELECT clip_id, shot_id, round(CASE WHEN count(*) >= 3 AND max(sqrt((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0))) > 0 THEN greatest(0, max(y0 + (y1 - y0) * ((frame - f0) / (f1 - f0)) - y)) / max(sqrt((x1-x0)*(x1-x0) + (y1-y0)*(y1-y0))) END, 6) AS arc FROM ed GROUP BY clip_id, shot_id)"""
_BOUNCED = f"""iv AS (SELECT clip_id, shot_id, frame, lag(frame) OVER ({_NEXT}) AS before_ FROM fx_shots),
    ip AS (SELECT iv.clip_id, shot_id, b.frame, pixel_y AS y FROM iv JOIN fx_ball b ON b.clip_id = iv.clip_id AND b.frame > before_ AND b.frame < iv.frame WHERE visible OR interpolated),
    iw AS (SELECT clip_id, shot_id, y, row_number() OVER w AS place, count(*) OVER (PARTITION BY clip_id, shot_id) AS n, max(y) OVER (w ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS top, min(y) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS bf, min(y) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS af FROM ip WINDOW w AS (PARTITION BY clip_id, shot_id ORDER BY frame)),
    bo AS (SELECT clip_id, shot_id, CASE WHEN max(n) >= 5 THEN bool_or(place > 2 AND place <= n - 2 AND y = top AND y - bf >= 14 AND y - af >= 20) END AS bounced FROM iw GROUP BY clip_id, shot_id)"""
_ZN = "CASE WHEN abs({y} - 22) <= 9 THEN 'kitchen' WHEN abs({y} - 22) >= 17 THEN 'baseline' WHEN {y} IS NOT NULL THEN 'transition' END"
_HEIGHT = (f"CASE WHEN impact_y <= {_mean(_seen('ls', 0.5, 'y'), _seen('rs', 0.5, 'y'))} THEN 'high' WHEN impact_y >= {_mean(_seen('lh', 0.5, 'y'), _seen('rh', 0.5, 'y'))} THEN 'low' ELSE 'mid' END")


def _context_sql() -> str:
    return f"""sx AS (SELECT *, lead(track_id) OVER w AS next_track, coalesce(lag(is_serve) OVER w AND lag(hitter_side) OVER w <> hitter_side, false) AS is_return FROM fx_shots WINDOW w AS ({_NEXT})),
    cx AS (SELECT s.clip_id, s.shot_id, is_serve, is_return, {_ZN.format(y='coalesce(f.front_y, 22)')} AS zone, {_ZN.format(y='r.front_y')} AS receiver_zone, CASE WHEN NOT coalesce((c.court_y_ft >= 22) = (land_y >= 22) AND abs(land_y - 22) > 9, false) THEN land_y END AS landing_y,
      round(speed_pre * fps / (near_px_per_ft + (far_px_per_ft - near_px_per_ft) * least(greatest(coalesce(c.court_y_ft, 22) / 44, 0), 1)), 6) AS pre_ftps, round(speed_post * fps / (near_px_per_ft + (far_px_per_ft - near_px_per_ft) * least(greatest(coalesce(c.court_y_ft, 22) / 44, 0), 1)), 6) AS post_ftps, {_HEIGHT} AS height
      FROM sx s JOIN fx_court q ON q.clip_id = s.clip_id LEFT JOIN (SELECT * FROM fx_contacts WHERE part = 'hitter') c ON c.clip_id = s.clip_id AND c.frame = s.frame AND c.track_id = s.track_id LEFT JOIN ff f ON f.clip_id = s.clip_id AND f.frame = s.frame AND f.track_id = s.track_id
      LEFT JOIN fx_poses p ON p.clip_id = s.clip_id AND p.frame = s.frame AND p.track_id = s.track_id LEFT JOIN ff r ON r.clip_id = s.clip_id AND r.frame = s.frame AND r.track_id = s.next_track LEFT JOIN ld ON ld.clip_id = s.clip_id AND ld.shot_id = s.shot_id)"""


_TYPES = """ty AS (SELECT cx.*, volley, arc, CASE WHEN u THEN sp.speed ELSE post_ftps END AS speed, CASE WHEN u THEN 26 ELSE 25 END AS fastest, CASE WHEN u THEN 23 ELSE 16 END AS slowest FROM (
      SELECT cx.*, NOT coalesce(bounced, li.ok, false) AND NOT is_serve AND cx.shot_id <> first_shot AS volley, arc FROM cx LEFT JOIN bo USING (clip_id, shot_id) LEFT JOIN (SELECT DISTINCT clip_id, next_shot AS shot_id, true AS ok FROM lk WHERE next_shot IS NOT NULL) li USING (clip_id, shot_id)
      LEFT JOIN ar USING (clip_id, shot_id) JOIN (SELECT clip_id, arg_min(shot_id, frame) AS first_shot FROM fx_shots GROUP BY clip_id) USING (clip_id)) cx
      LEFT JOIN sp USING (clip_id, shot_id), LATERAL (SELECT coalesce(sp.confidence >= 0.6 AND NOT (volley AND sp.anchor = 'bounce'), false) AS u)),
    tz AS (SELECT *, coalesce(speed >= fastest, false) AS fast, coalesce(speed <= slowest, false) AS slow, coalesce(arc >= 0.35, false) AS high, coalesce(arc >= 0.15, false) AS loft, zone = 'baseline' AS deep, CASE WHEN abs(landing_y - 22) <= 9 THEN 'k' WHEN abs(landing_y - 22) >= 17 THEN 'b' WHEN landing_y IS NOT NULL THEN 't' END AS down FROM ty),
    rt AS (SELECT *, CASE WHEN is_serve THEN 'serve 0.95' WHEN is_return THEN 'return 0.9' WHEN volley AND zone = 'kitchen' AND NOT fast THEN 'dink 0.35' WHEN volley THEN 'drive 0.4' WHEN high AND NOT fast AND receiver_zone = 'kitchen' THEN 'lob arc'
      WHEN down = 'k' THEN CASE WHEN deep THEN 'drop 0.78' ELSE 'dink 0.78' END WHEN down IS NOT NULL AND deep THEN 'drive 0.78' WHEN down = 't' AND (CASE WHEN arc IS NULL THEN slow ELSE loft END) THEN 'dink 0.7' WHEN down = 'b' AND (CASE WHEN arc IS NULL THEN slow ELSE high END) THEN 'lob 0.7' WHEN down IS NOT NULL THEN 'drive 0.78'
      WHEN fast THEN 'drive 0.4' WHEN slow AND NOT deep THEN CASE WHEN pre_ftps >= 25 THEN 'reset 0.35' ELSE 'dink 0.35' END WHEN slow THEN 'drop 0.3' WHEN speed IS NULL THEN 'unknown 0.2' WHEN loft THEN 'drop 0.25' ELSE 'drive 0.25' END AS tag FROM tz)
    SELECT clip_id, shot_id, split_part(tag, ' ', 1) AS shot_type, CASE WHEN tag = 'lob arc' THEN least(1, greatest(0.6, arc)) ELSE CAST(split_part(tag, ' ', 2) AS DOUBLE) END AS confidence FROM rt"""


def register(add, linked: str) -> None:
    """``add(name, run, sql)`` takes a query and its twin; ``linked`` is the CTE of bounces between shots."""
    feet = lambda get: S.front_feet(get("contacts"), get("poses"), get("court"))
    landed = lambda get: T.landing(get("bounces"), get("shots"))
    side = "CASE WHEN sure >= 0.35 THEN CASE WHEN off <> 0 AND ((rsx > lsx) = (hand = 'right')) = (off > 0) THEN 'forehand' ELSE 'backhand' END ELSE 'unknown' END"
    wx, wy = (f"CASE hand WHEN 'right' THEN {_seen('rw', 0.3, c)} WHEN 'left' THEN {_seen('lw', 0.3, c)} END" for c in "xy")
    add("g9_g12_body_measures", lambda get: S.body_measures(get("poses"), get("contacts"), get("shots"), get("roles"), get("roster"), get("court")), f"""ic AS (SELECT clip_id, {_COF} FROM fx_court),
    m AS (SELECT p.*, shot_id, impact_x, impact_y, is_serve, hand, abs(rsx - lsx) AS width, {_IMG.format(i=0, x='10', y='p.court_y_ft')} AS px, {_IMG.format(i=1, x='10', y='p.court_y_ft')} AS py,
      {_IMG.format(i=0, x='10', y='(p.court_y_ft + CASE WHEN p.court_y_ft < 22 THEN 1 ELSE -1 END)')} AS qx, {_IMG.format(i=1, x='10', y='(p.court_y_ft + CASE WHEN p.court_y_ft < 22 THEN 1 ELSE -1 END)')} AS qy, {wx} AS wx, {wy} AS wy
      FROM fx_poses p JOIN (SELECT clip_id, frame, track_id, shot_id, impact_x, impact_y FROM fx_contacts WHERE part = 'hitter') c ON c.clip_id = p.clip_id AND c.frame = p.frame AND c.track_id = p.track_id
      JOIN (SELECT clip_id AS sc, shot_id AS ss, is_serve FROM fx_shots) s ON sc = p.clip_id AND ss = shot_id JOIN ic ON ic.clip_id = p.clip_id LEFT JOIN fx_roles r ON r.clip_id = p.clip_id AND r.track_id = p.track_id LEFT JOIN fx_roster USING (role)),
    t AS (SELECT *, CASE WHEN hand IS NOT NULL AND lsv >= 0.5 AND rsv >= 0.5 AND width > 0 THEN round(least(1, abs(impact_x - (lsx + rsx) / 2) / (0.5 * width)), 3) END AS sure, impact_x - (lsx + rsx) / 2 AS off FROM m),
    u AS (SELECT *, {side} AS side FROM t)
    SELECT clip_id, shot_id, round({_mean(_angle('l'), _angle('r'))}, 1) AS knee_deg, CASE WHEN width > 0 THEN round(((wx - (lhx + rhx) / 2) * (qx - px) + (wy - (lhy + rhy) / 2) * (qy - py)) / (sqrt((qx-px)*(qx-px) + (qy-py)*(qy-py)) * width), 6) END AS front, {_HEIGHT} AS height,
      CASE WHEN is_serve AND side = 'unknown' AND hand IS NOT NULL THEN 'forehand' ELSE side END AS stroke_side, CASE WHEN is_serve AND side = 'unknown' AND hand IS NOT NULL THEN greatest(coalesce(sure, 0), 0.6) ELSE coalesce(sure, 0) END AS stroke_confidence FROM u""")
    add("g13_m11_front_feet", lambda get: feet(get).select("clip_id", "frame", "track_id", F.round("front_x", 6).alias("front_x"), F.round("front_y", 6).alias("front_y")), _FEET + " SELECT clip_id, frame, track_id, round(front_x, 6) AS front_x, round(front_y, 6) AS front_y FROM ff")
    add("p13_pose_scope", lambda get: S.pose_scope(get("contacts"), get("roles")), """n AS (SELECT c.clip_id, c.track_id, CASE WHEN is_user THEN 'user' WHEN role <> 'noise' THEN role END AS reason FROM fx_contacts c JOIN fx_roles r ON r.clip_id = c.clip_id AND r.track_id = c.track_id)
    SELECT clip_id, reason, count(*) AS rows_to_pose, count(DISTINCT track_id) AS tracks FROM n WHERE reason IS NOT NULL GROUP BY ALL""")
    add("p14_pose_rate", lambda get: S.pose_rate(get("contacts"), get("poses")), """j AS (SELECT c.clip_id, c.track_id, is_user, CASE WHEN p.n IS NULL THEN 0 ELSE 1 END AS posed FROM fx_contacts c LEFT JOIN fx_poses p ON p.clip_id = c.clip_id AND p.frame = c.frame AND p.track_id = c.track_id WHERE part = 'hitter')
    SELECT clip_id, track_id, count(*) AS n_rows, avg(posed) AS rate, bool_or(is_user) AS is_user, bool_or(is_user) AND avg(posed) < 0.5 AS warn FROM j GROUP BY clip_id, track_id""")
    hips, shoulders, hands = (_mean(_seen("l" + p, 0.3, "y"), _seen("r" + p, 0.3, "y")) for p in "hsw")
    med = lambda z: f"CASE WHEN count_if(zone = '{z}') >= 20 THEN quantile_cont(CASE WHEN zone = '{z}' THEN ready END, 0.5) END"
    add("m17_ready_position", lambda get: S.ready_position(get("poses"), get("roles"), get("shots")), f"""r AS (SELECT role, {_ZN.format(y='court_y_ft')} AS zone, CASE WHEN {hips} > {shoulders} THEN ({hips} - {hands}) / ({hips} - {shoulders}) END AS ready
      FROM fx_poses p JOIN fx_roles ro ON ro.clip_id = p.clip_id AND ro.track_id = p.track_id WHERE role <> 'noise' AND NOT EXISTS (SELECT 1 FROM fx_shots s WHERE s.clip_id = p.clip_id AND s.track_id = p.track_id AND NOT s.is_serve AND abs(s.frame - p.frame) <= 2))
    SELECT *, CASE WHEN n_rows >= 30 THEN kitchen > baseline + 0.05 END AS rises_at_net FROM (SELECT role, count(*) AS n_rows, {med('kitchen')} AS kitchen, {med('transition')} AS transition, {med('baseline')} AS baseline FROM r WHERE ready IS NOT NULL GROUP BY role)""")
    add("t1_landing", landed, f"{linked}, {_LAND} SELECT * FROM ld")
    seen = lambda get: {name: get(name, tiled=True) for name in ("shots", "contacts", "poses")} | {name: get(name) for name in ("bounces", "court")}
    add("t2_anchored_speed", lambda get: T.speed_by_tile(**seen(get)), _speed_sql(linked) + " SELECT * FROM sp")
    add("t3_arc_height", lambda get: T.arc_height(T.flight_points(get("shots"), get("ball"))), _ARC + " SELECT * FROM ar")
    add("t4_bounced_between", lambda get: T.bounced_between(get("shots"), get("ball")), _BOUNCED + " SELECT * FROM bo")
    add("t6_shot_context", lambda get: T.context_by_tile(**seen(get)), f"{linked}, {_LAND}, {_FEET}, {_context_sql()} SELECT * FROM cx")
    add("t8_classify_type", lambda get: T.typed_by_tile(**seen(get), ball=get("ball")),
        f"{_speed_sql(linked)}, {_ARC}, {_BOUNCED}, {_context_sql()}, {_TYPES}")
    add("b13_camera_ground", lambda get: T.camera_ground(get("contacts").withColumns({c: F.col(c) + F.col("n") % 7 for c in ("bbox_x1", "bbox_x2")})).select("clip_id", "n_rows", *[F.round(c, 3).alias(c) for c in ("ground_x", "ground_y", "k", "camera_ft")]), """l AS (SELECT clip_id, foot_x AS fx, foot_y AS fy, (bbox_x1 + bbox_x2) / 2 + n % 7 AS hx, bbox_y1 AS hy FROM fx_contacts WHERE in_court AND frame % 4 = 0),
    u AS (SELECT *, (hx - fx) / sqrt((hx-fx)*(hx-fx) + (hy-fy)*(hy-fy)) AS ux, (hy - fy) / sqrt((hx-fx)*(hx-fx) + (hy-fy)*(hy-fy)) AS uy FROM l),
    s AS (SELECT clip_id, count(*) AS n_rows, sum(1 - ux*ux) AS a, sum(-ux*uy) AS b, sum(1 - uy*uy) AS d, sum((1 - ux*ux)*fx - ux*uy*fy) AS p, sum(-ux*uy*fx + (1 - uy*uy)*fy) AS q FROM u GROUP BY clip_id),
    g AS (SELECT clip_id, n_rows, CASE WHEN n_rows >= 20 AND abs(a*d - b*b) > 1e-9 THEN (p*d - q*b) / (a*d - b*b) END AS gx, CASE WHEN n_rows >= 20 AND abs(a*d - b*b) > 1e-9 THEN (q*a - p*b) / (a*d - b*b) END AS gy FROM s),
    k AS (SELECT clip_id, n_rows, gx, gy, quantile_cont(sqrt((gx-fx)*(gx-fx) + (gy-fy)*(gy-fy)) / sqrt((gx-hx)*(gx-hx) + (gy-hy)*(gy-hy)), 0.5) AS k FROM u JOIN g USING (clip_id) GROUP BY ALL)
    SELECT clip_id, n_rows, round(gx, 3) AS ground_x, round(gy, 3) AS ground_y, round(k, 3) AS k, round(CASE WHEN k > 1 THEN 5.6 / (1 - 1 / k) END, 3) AS camera_ft FROM k""")
    cal = """fi AS (SELECT clip_id, regr_slope(measured_px, predicted_px) AS s, regr_intercept(measured_px, predicted_px) AS i, count(*) AS n FROM fx_sizes WHERE at_bounce AND measured_px / predicted_px < 2 GROUP BY clip_id),
    ca AS (SELECT clip_id, CASE WHEN coalesce(n >= 8 AND s > 0.2, false) THEN round(s, 6) ELSE 1.25 END AS slope, CASE WHEN coalesce(n >= 8 AND s > 0.2, false) THEN round(i, 6) ELSE 2.5 END AS intercept, coalesce(n >= 8 AND s > 0.2, false) AS fitted FROM (SELECT DISTINCT clip_id FROM fx_sizes) LEFT JOIN fi USING (clip_id))"""
    add("b14_size_calibration", lambda get: T.size_calibration(get("sizes")), cal + " SELECT * FROM ca")
    rec = cal + """, kk AS (SELECT z.*, greatest(1, greatest((measured_px - intercept) / slope, 0.1) / predicted_px) AS k FROM fx_sizes z JOIN ca USING (clip_id)),
    re AS (SELECT clip_id, frame, at_bounce, ground_x, ground_y, 10 + (ground_x - 10) / k AS x, -15 + (ground_y + 15) / k AS y, 12 * (1 - 1 / k) AS z FROM kk)"""
    solid = lambda get: T.reconstruct_3d(get("sizes"), T.size_calibration(get("sizes")))
    add("b15_reconstruct_3d", lambda get: solid(get).select("clip_id", "frame", *[F.round(c, 4).alias(c) for c in "xyz"]), rec + " SELECT clip_id, frame, round(x, 4) AS x, round(y, 4) AS y, round(z, 4) AS z FROM re")
    add("b15_reconstruction_report", lambda get: T.reconstruction_report(solid(get)), rec + """ SELECT clip_id, avg(CAST(ground_x BETWEEN -5 AND 25 AND ground_y BETWEEN -15 AND 59 AS INT)) AS inside_raw, avg(CAST(x BETWEEN -5 AND 25 AND y BETWEEN -15 AND 59 AS INT)) AS inside_3d,
      quantile_cont(CASE WHEN at_bounce THEN z END, 0.5) AS median_bounce_z FROM re GROUP BY clip_id""")
    at = lambda i, dx, dy: _IMG.format(i=i, x=f"(x + {dx})", y=f"(y + {dy})")
    arm = lambda dx, dy: f"sqrt(({at(0, dx, dy)} - {at(0, 0, 0)}) * ({at(0, dx, dy)} - {at(0, 0, 0)}) + ({at(1, dx, dy)} - {at(1, 0, 0)}) * ({at(1, dx, dy)} - {at(1, 0, 0)}))"
    add("b16_local_px_per_ft", lambda get: T.ball_scale(get("ball"), get("court")), f"""ic AS (SELECT *, {_COF} FROM fx_court), g AS (SELECT frame, ic.*, (h00*pixel_x + h01*pixel_y + h02) / (h20*pixel_x + h21*pixel_y + h22) AS x, (h10*pixel_x + h11*pixel_y + h12) / (h20*pixel_x + h21*pixel_y + h22) AS y FROM fx_ball JOIN ic USING (clip_id) WHERE visible OR interpolated)
    SELECT clip_id, frame, round(sqrt({arm(1, 0)} * {arm(0, 1)}), 4) AS px_per_ft FROM g""")
    qs = ", ".join(f"quantile_cont(CASE WHEN {test} THEN measured_px / predicted_px END, {q / 100}) AS {name}_p{q}" for test, name in (("at_bounce", "bounce"), ("NOT at_bounce", "flight")) for q in (10, 25, 50, 75, 90))
    add("b17_size_separability", lambda get: T.size_separability(get("sizes")), f"""ti AS (SELECT clip_id, measured_px / predicted_px AS r, count_if(at_bounce) AS b, count_if(NOT at_bounce) AS f FROM fx_sizes GROUP BY ALL),
    au AS (SELECT clip_id, sum(f * (below + b / 2)) / (sum(b) * sum(f)) AS auc FROM (SELECT *, coalesce(sum(b) OVER (PARTITION BY clip_id ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM ti) GROUP BY clip_id)
    SELECT * FROM (SELECT clip_id, {qs} FROM fx_sizes GROUP BY clip_id) JOIN au USING (clip_id)""")
