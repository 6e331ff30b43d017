"""Queries of the tracking operators over the test tables, with the SQL that DuckDB runs for the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import ball as B
from ..operators import collections_ as A
from ..operators import evaluation as E
from ..operators import helpers as H
from ..operators import metrics as M
from ..operators import rallies as R
from ..operators import shots as D
from ..operators import tracks as P
from ..sources.adapters import fixtures, with_fixtures
from . import bounce_plans, chain_plans, coaching_plans, contact_plans, court_plans, report_plans, review_plans, role_plans, union_plans

_Q: dict = {}
_S: dict[str, str] = {}


def _add(name: str, run, sql: str | None = None) -> None:
    """``run(get)`` builds the query from fixtures ``get(name)``."""
    def query(spark, sf_dir):
        get = fixtures(spark, sf_dir)
        return run(lambda fx, **more: get(fx if fx.startswith("fx_") else f"fx_{fx}", **more))

    _Q[name] = query
    if sql:
        _S[name] = with_fixtures(_counted(sql))


def _counted(sql: str) -> str:
    """``count_if(x)`` as a filtered count, which DuckDB gives as BIGINT like Spark."""
    while (at := sql.find("count_if(")) >= 0:
        end, depth = at + 9, 1
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        sql = f"{sql[:at]}count(*) FILTER (WHERE {sql[at + 9: end - 1]}){sql[end:]}"
    return sql


KNOWN = "(visible OR interpolated)"
_PROJ = "(h00*{x} + h01*{y} + h02) / (h20*{x} + h21*{y} + h22) AS {a}, (h10*{x} + h11*{y} + h12) / (h20*{x} + h21*{y} + h22) AS {b}"
_RECT = "coalesce({x} BETWEEN -{s} AND 20 + {s} AND {y} BETWEEN -{e} AND 44 + {e}, false)"
_ZONE = "CASE WHEN abs({y} - 22) <= 9 THEN 'kitchen' WHEN abs({y} - 22) >= 17 THEN 'baseline' WHEN {y} IS NOT NULL THEN 'transition' END"
_LINKED = """ev AS (SELECT clip_id, frame, bounce_id, NULL AS shot_id FROM fx_bounces UNION ALL SELECT clip_id, frame, NULL, shot_id FROM fx_shots),
    lk AS (SELECT * FROM (SELECT clip_id, bounce_id, frame,
        max(shot_id) OVER (PARTITION BY clip_id ORDER BY frame RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_shot,
        min(shot_id) OVER (PARTITION BY clip_id ORDER BY frame RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_shot,
        frame - max(CASE WHEN shot_id IS NOT NULL THEN frame END) OVER (PARTITION BY clip_id ORDER BY frame RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS frames_since,
        min(CASE WHEN shot_id IS NOT NULL THEN frame END) OVER (PARTITION BY clip_id ORDER BY frame RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) - frame AS frames_to FROM ev) WHERE bounce_id IS NOT NULL)"""
_BROWS = f"""br AS (SELECT clip_id, bounce_id, w <= 0.25 AS is_in, CASE WHEN w <= 0.25 THEN NULL WHEN -court_x_ft = w THEN 'left' WHEN court_x_ft - 20 = w THEN 'right' WHEN -court_y_ft = w THEN 'near' ELSE 'far' END AS out_side,
        {_ZONE.format(y='court_y_ft')} AS zone, CASE WHEN court_y_ft < 22 THEN 'near' ELSE 'far' END AS side
        FROM (SELECT *, greatest(-court_x_ft, court_x_ft - 20, -court_y_ft, court_y_ft - 44) AS w FROM fx_bounces) WHERE w <= 8)"""
_POS = "po AS (SELECT clip_id, role, frame, round(avg(court_x_ft), 6) + 0.0E0 AS x, round(avg(court_y_ft), 6) + 0.0E0 AS y FROM fx_players JOIN fx_roles USING (clip_id, track_id) WHERE NOT transient AND role <> 'noise' GROUP BY ALL)"
_MIX = """mx AS (SELECT clip_id, role, count(*) AS shots, count_if(shot_type = 'serve') AS serve, count_if(shot_type = 'drive') AS drive, count_if(shot_type = 'dink') AS dink, count_if(shot_type = 'drop') AS "drop", count_if(shot_type = 'lob') AS lob,
        count_if(is_volley) AS volleys, count_if(stroke_side = 'forehand') AS forehands, avg(CAST(is_volley AS INT)) AS volley_rate FROM fx_shots JOIN fx_roles USING (clip_id, track_id) GROUP BY GROUPING SETS ((clip_id), (clip_id, role)))"""
# Stand-in players jump over the whole court: an eighth of their way is walked.
_MOVE = """mf AS (SELECT p.clip_id, role, frame, min(rally_id) AS rally_id, any_value(x) / 8 AS x, any_value(y) / 8 AS y FROM po p JOIN fx_rallies r ON r.clip_id = p.clip_id AND frame BETWEEN start_frame AND end_frame GROUP BY ALL),
    mb AS (SELECT clip_id, role, rally_id, fps, CAST(round(0.2 * fps) AS INT) AS win, floor(frame / CAST(round(0.2 * fps) AS INT)) AS bucket, avg(x) AS x, avg(y) AS y, count(*) AS n FROM mf JOIN fx_court USING (clip_id) GROUP BY ALL),
    ms AS (SELECT *, CASE WHEN bucket - lag(bucket) OVER w = 1 AND rally_id = lag(rally_id) OVER w THEN sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) END AS step FROM mb WINDOW w AS (PARTITION BY clip_id, role ORDER BY bucket, rally_id)),
    mt AS (SELECT clip_id, role, count_if(step BETWEEN 0.3 AND 24.0 * win / fps) AS steps, coalesce(sum(CASE WHEN step BETWEEN 0.3 AND 24.0 * win / fps THEN step END), 0) AS feet, count(DISTINCT rally_id) AS rallies, CAST(sum(n) AS DOUBLE) / max(fps) / 60 AS minutes FROM ms GROUP BY clip_id, role)"""


def _slowed(positions):
    return positions.withColumns({"x": F.col("x") / 8, "y": F.col("y") / 8})


def _moves(get):
    return M.movement(_slowed(M.role_positions(get("players"), get("roles"))), get("rallies"), get("court"))


def _scored(get):
    """Category levels; contact in front of the hip and knee bends are stand-ins."""
    shots = get("shots").withColumns({"front": F.expr("CASE WHEN pk % 7 <> 0 THEN CAST(pk % 61 - 20 AS DOUBLE) / 20 END"), "knee": F.expr("CASE WHEN pk % 5 <> 0 THEN pk % 60 END")})
    return M.score_categories(M.rating_drivers(shots, get("roles"), M.role_positions(get("players"), get("roles")), _moves(get), get("rallies")))


def _lin(v, x0, y0, x1, y1):
    return f"coalesce(CASE WHEN {v} IS NOT NULL THEN {y0} + ({y1} - ({y0})) * least(greatest(({v} - {x0}) / ({x1} - {x0}), 0.0E0), 1.0E0) END, 0.0E0)"


def _level(known, value):
    return f"CAST(round(CASE WHEN {known} THEN least(greatest({value}, 1.0E0), 5.5E0) ELSE 3.0E0 END, 6) AS DOUBLE)"


def _stroke(side):
    return _level(f"{side}_n >= 4", _lin(f"{side}_front", 0.0, 3.0, 2.5, 4.2) + f" + CASE WHEN {side}_knee_n >= 3 THEN " + _lin(f"{side}_knee", 0.0, -0.2, 1.0, 0.3) + " ELSE 0.0E0 END")


_LEVELS = {
    "strategy": _level("kitchen IS NOT NULL", " ".join([_lin("kitchen", 0.0, 2.5, 0.6, 4.5), "+", _lin("both_kitchen", 0.0, 0.0, 0.5, 0.4), "-", _lin("transition", 0.2, 0.0, 0.6, 0.6), "+", _lin("per_min", 40.0, 0.0, 200.0, 0.2)])),
    "third_shot": _level("thirds >= 4 AND drop_rate IS NOT NULL", _lin("drop_rate", 0.1, 2.8, 0.6, 4.3)),
    "dink": _level("dink_share IS NOT NULL", " ".join([_lin("dink_share", 0.0, 2.8, 0.4, 4.3), "+", _lin("mean_length", 3.0, 0.0, 10.0, 0.3), "+ CASE WHEN dink_knee_n >= 3 THEN", _lin("dink_knee", 0.0, 0.0, 1.0, 0.5), "ELSE 0.0E0 END"])),
    "volley": _level("volley_rate IS NOT NULL", _lin("volley_rate", 0.0, 2.8, 0.4, 4.2)), "serve_return": _level("serves > 0", _lin("(coalesce(faults, 0) / serves)", 0.0, 4.2, 0.3, 2.5)),
    "forehand": _stroke("forehand"), "backhand": _stroke("backhand")}
_SIDES = ", ".join(f"""count(CASE WHEN stroke_side = '{s}' THEN front END) AS {s}_n, avg(CASE WHEN stroke_side = '{s}' THEN front END) AS {s}_front, count(CASE WHEN stroke_side = '{s}' AND shot_type = 'drive' THEN knee END) AS {s}_knee_n,
      avg(CASE WHEN stroke_side = '{s}' AND shot_type = 'drive' AND knee IS NOT NULL THEN CAST(knee BETWEEN 20 AND 35 AS INT) END) AS {s}_knee""" for s in ("forehand", "backhand"))
_SCORES = _POS + ", " + _MOVE + f""", sk AS (SELECT s.*, role, CASE WHEN pk % 7 <> 0 THEN CAST(pk % 61 - 20 AS DOUBLE) / 20 END AS front, CASE WHEN pk % 5 <> 0 THEN pk % 60 END AS knee FROM fx_shots s JOIN fx_roles r ON r.clip_id = s.clip_id AND r.track_id = s.track_id),
    d1 AS (SELECT clip_id, role, count(*) AS shots, avg(CAST(shot_type = 'dink' AS INT)) AS dink_share, avg(CAST(is_volley AS INT)) AS volley_rate, count_if(is_serve) AS serves, count_if(seq = 3 AND shot_type IN ('drop', 'drive')) AS thirds,
      avg(CASE WHEN seq = 3 AND shot_type IN ('drop', 'drive') THEN CAST(shot_type = 'drop' AS INT) END) AS drop_rate, count(CASE WHEN shot_type = 'dink' THEN knee END) AS dink_knee_n, avg(CASE WHEN shot_type = 'dink' AND knee IS NOT NULL THEN CAST(knee BETWEEN 35 AND 50 AS INT) END) AS dink_knee, {_SIDES} FROM sk GROUP BY clip_id, role),
    d2 AS (SELECT clip_id, role, avg(CAST(abs(y - 22) <= 9 AS INT)) AS kitchen, avg(CAST(abs(y - 22) > 9 AND abs(y - 22) < 17 AS INT)) AS transition FROM po GROUP BY clip_id, role),
    d3 AS (SELECT a.clip_id, avg(CAST(abs(a.y - 22) <= 9 AND abs(b.y - 22) <= 9 AS INT)) AS both_kitchen FROM po a JOIN po b ON a.clip_id = b.clip_id AND a.frame = b.frame AND a.role = 'user' AND b.role = 'partner' GROUP BY a.clip_id),
    d4 AS (SELECT r.clip_id, role, count(*) AS faults FROM fx_rallies r JOIN sk ON sk.clip_id = r.clip_id AND sk.shot_id = first_shot WHERE end_reason = 'serve_fault' GROUP BY r.clip_id, role), d5 AS (SELECT clip_id, avg(n_shots) AS mean_length FROM fx_rallies GROUP BY clip_id),
    dr AS (SELECT d1.*, kitchen, transition, both_kitchen, round(feet / minutes, 4) AS per_min, mean_length, faults FROM d1 LEFT JOIN d2 USING (clip_id, role) LEFT JOIN mt USING (clip_id, role) LEFT JOIN d3 USING (clip_id) LEFT JOIN d4 USING (clip_id, role) LEFT JOIN d5 USING (clip_id)),
    sc AS (SELECT clip_id, role, u.category, u.level, shots / (shots + 8) AS confidence, u.weight FROM dr, LATERAL (VALUES """ + ", ".join(f"('{k}', {v}, {M.WEIGHTS[k]}E0)" for k, v in _LEVELS.items()) + ") AS u(category, level, weight))"
_W = "PARTITION BY clip_id ORDER BY frame"


# ---- geometry and scalar expressions

def _geometry(get):
    b = get("ball").filter(B.KNOWN()).join(get("court"), "clip_id")
    x, y = geo.project(F.col("pixel_x"), F.col("pixel_y"))
    p = b.select("clip_id", "frame", "pixel_x", "near_px_per_ft", "far_px_per_ft", x.alias("x"), y.alias("y"))
    return p.select("clip_id", "frame", "x", "y", geo.in_rect(F.col("x"), F.col("y"), 5, 15).alias("in_envelope"), geo.zone(F.col("y")).alias("zone"), geo.lateral(F.col("x")).alias("lateral"),
                    geo.side_of_net(F.col("y")).alias("side"), geo.px_per_ft(F.col("y"), F.col("near_px_per_ft"), F.col("far_px_per_ft")).alias("px_per_ft"))


_add("g1_g6_project_and_zone", _geometry, f"""p AS (SELECT clip_id, frame, near_px_per_ft, far_px_per_ft, {_PROJ.format(x='pixel_x', y='pixel_y', a='x', b='y')} FROM fx_ball JOIN fx_court USING (clip_id) WHERE {KNOWN})
    SELECT clip_id, frame, x, y, {_RECT.format(x='x', y='y', s=5, e=15)} AS in_envelope, {_ZONE.format(y='y')} AS zone,
      CASE WHEN least(greatest(x, 0), 20) < 20.0E0/3 THEN 'left' WHEN least(greatest(x, 0), 20) < 40.0E0/3 THEN 'centre' ELSE 'right' END AS lateral, CASE WHEN y < 22 THEN 'near' ELSE 'far' END AS side,
      near_px_per_ft + (far_px_per_ft - near_px_per_ft) * least(greatest(y / 44, 0), 1) AS px_per_ft FROM p""")
_add("g3_n6_bounce_rows", lambda get: D.bounce_rows(get("bounces")), _BROWS + " SELECT * FROM br")
_add("g5_receivers_kitchen", lambda get: get("bounces").select("clip_id", "bounce_id", geo.in_receivers_kitchen(F.col("court_y_ft"), F.when(F.col("made_by") % 2 == 0, "near").otherwise("far")).alias("inside")),
     "SELECT clip_id, bounce_id, CASE WHEN made_by % 2 = 0 THEN court_y_ft BETWEEN 22 AND 29 ELSE court_y_ft BETWEEN 15 AND 22 END AS inside FROM fx_bounces")

# ---- players
_add("p1_smooth_and_project", lambda get: P.smooth_and_project(get("players"), get("court")), f"""
    s AS (SELECT clip_id, track_id, frame, quantile_cont(foot_x, 0.5) OVER w AS foot_x, quantile_cont(foot_y, 0.5) OVER w AS foot_y FROM fx_players WINDOW w AS (PARTITION BY clip_id, track_id ORDER BY frame ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING)),
    p AS (SELECT clip_id, track_id, frame, foot_x, foot_y, {_PROJ.format(x='foot_x', y='foot_y', a='court_x_ft', b='court_y_ft')} FROM s JOIN fx_court USING (clip_id))
    SELECT *, {_RECT.format(x='court_x_ft', y='court_y_ft', s=0, e=0)} AS in_court, {_RECT.format(x='court_x_ft', y='court_y_ft', s=6, e=6)} AS court_pos_reliable FROM p""")
_ZONED = _RECT.format(x="court_x_ft", y="court_y_ft", s=5, e=15)
_add("p2_flag_transient", lambda get: P.flag_transient(get("players")), f"""
    SELECT clip_id, track_id, max(frame) - min(frame) + 1 AS life, bool_or({_ZONED}) AS in_zone, max(frame) - min(frame) + 1 < 30 OR NOT bool_or({_ZONED}) AS transient FROM fx_players GROUP BY clip_id, track_id""")
# The stand-in tracks have a row in every sixth frame, and seven of them stay in court.
_add("p3_crowd_warning", lambda get: P.crowd_warning(get("players").withColumns({"frame": F.col("frame") * 6, "in_court": F.col("in_court") | (F.col("track_id") < 7)}), get("court")), """t AS (SELECT clip_id, track_id, max(frame * 6) - min(frame * 6) + 1 AS life, avg(CAST(in_court OR track_id < 7 AS INT)) AS inside FROM fx_players GROUP BY clip_id, track_id)
    SELECT clip_id, count(*) AS tracks, list(track_id ORDER BY track_id) AS track_ids FROM t JOIN fx_court USING (clip_id) WHERE life > 5 * fps AND inside >= 0.8 GROUP BY clip_id HAVING count(*) > 4""")
_SUMMARY = f"""su AS (SELECT clip_id, track_id, count(*) AS rows, min(frame) AS first_frame, max(frame) AS last_frame, arg_min(court_x_ft, frame) AS first_x, arg_max(court_x_ft, frame) AS last_x,
    quantile_cont(court_x_ft, 0.5) AS median_x, quantile_cont(court_y_ft, 0.5) AS median_y, quantile_cont(bbox_y2 - bbox_y1, 0.75) AS height_px, avg(CAST(in_court AS INT)) AS in_court_share,
    avg(CAST({_ZONED} AS INT)) AS in_envelope_share, avg(CAST(is_user AS INT)) AS user_share FROM fx_players GROUP BY clip_id, track_id)"""
_add("p6_track_summary", lambda get: P.track_summary(get("players")), _SUMMARY + " SELECT * FROM su")
_add("p7_noise_tracks", lambda get: P.noise_tracks(P.track_summary(get("players"))), _SUMMARY + f""" SELECT clip_id, track_id, CASE WHEN last_frame - first_frame + 1 < 60 THEN 'short' WHEN NOT {_RECT.format(x='median_x', y='median_y', s=5, e=15)} THEN 'outside' ELSE 'seldom' END AS reason
    FROM su WHERE last_frame - first_frame + 1 < 60 OR NOT {_RECT.format(x='median_x', y='median_y', s=5, e=15)} OR in_envelope_share < 0.15""")
_add("p5_user_segments", lambda get: P.user_segments(get("players"), 1), """u AS (SELECT DISTINCT clip_id, frame FROM fx_players WHERE is_user),
    c AS (SELECT *, CASE WHEN frame - lag(frame) OVER (PARTITION BY clip_id ORDER BY frame) > 1 THEN 1 ELSE 0 END AS cut FROM u), s AS (SELECT *, sum(cut) OVER (PARTITION BY clip_id ORDER BY frame)::BIGINT AS segment FROM c),
    o AS (SELECT clip_id, segment, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS frames FROM s GROUP BY ALL)
    SELECT *, lead(start_frame) OVER (PARTITION BY clip_id ORDER BY segment) - end_frame - 1 AS gap_after FROM o""")
_add("p8_seed_user", lambda get: P.seed_user(get("players")), """e AS (SELECT clip_id, track_id, quantile_cont(court_x_ft, 0.5) AS median_x FROM fx_players WHERE frame < 60 AND court_y_ft < 22 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER w AS place, median_x - lead(median_x) OVER w AS ahead FROM e WINDOW w AS (PARTITION BY clip_id ORDER BY median_x DESC, track_id))
    SELECT clip_id, track_id, median_x, ahead, CASE WHEN ahead < 2 THEN 0.5 ELSE least(0.9, 0.5 + coalesce(ahead, 8.0) / 20) END AS confidence FROM r WHERE place = 1""")
_add("p9_track_overlap", lambda get: P.track_overlap(get("players")), """p AS (SELECT DISTINCT clip_id, frame, track_id FROM fx_players WHERE NOT transient), n AS (SELECT clip_id, track_id, count(*) AS n FROM p GROUP BY ALL)
    SELECT a.clip_id, a.track_id, b.track_id AS other, count(*) AS shared, count(*) / any_value(n) AS share FROM p a JOIN p b ON a.clip_id = b.clip_id AND a.frame = b.frame AND a.track_id <> b.track_id
    JOIN n ON n.clip_id = a.clip_id AND n.track_id = a.track_id GROUP BY a.clip_id, a.track_id, b.track_id""")
_add("p12_role_summary", lambda get: P.role_summary(get("players"), get("roles")), """SELECT clip_id, role, count(DISTINCT track_id) AS tracks, count(DISTINCT frame) AS frames, count(*) AS rows, avg(CAST(is_user AS INT)) AS user_rows
    FROM fx_players JOIN fx_roles USING (clip_id, track_id) GROUP BY clip_id, role""")
_add("p15_role_consistency", lambda get: P.role_consistency(get("players"), get("roles")), """h AS (SELECT clip_id, role, frame, count(DISTINCT track_id) AS held FROM fx_players JOIN fx_roles USING (clip_id, track_id) WHERE role <> 'noise' GROUP BY ALL)
    SELECT clip_id, role, count(*) AS present, count_if(held > 1) AS duplicate FROM h GROUP BY ALL""")
_add("p16_role_timeline", lambda get: P.role_timeline(get("players"), get("roles")), """s AS (SELECT clip_id, role, track_id, min(frame) AS first_frame, max(frame) AS last_frame, count(*) AS rows FROM fx_players JOIN fx_roles USING (clip_id, track_id) GROUP BY ALL)
    SELECT *, row_number() OVER (PARTITION BY clip_id, role ORDER BY rows DESC, track_id) AS place FROM s QUALIFY place <= 2""")
_add("p17_sample_per_track", lambda get: P.sample_per_track(get("players")), """s AS (SELECT clip_id, track_id, frame, row_number() OVER (PARTITION BY clip_id, track_id ORDER BY frame) - 1 AS i, count(*) OVER (PARTITION BY clip_id, track_id) AS n FROM fx_players)
    SELECT clip_id, track_id, frame FROM s WHERE list_contains([floor(k * (n - 1) / 4) FOR k IN range(5)], i)""")

# ---- ball
_add("s5_check_ball", lambda get: B.check_ball(get("ball")), f"""b AS (SELECT *, frame - coalesce(lag(frame) OVER ({_W}), -1) <> 1 AS gap FROM fx_ball)
    SELECT clip_id, count_if(visible AND interpolated) AS both_flags, count_if({KNOWN} AND (pixel_x IS NULL OR pixel_y IS NULL)) AS known_without_xy, count_if(NOT {KNOWN} AND (pixel_x IS NOT NULL OR pixel_y IS NOT NULL)) AS unknown_with_xy,
    count_if(gap) AS frame_gaps, count_if((confidence IS NOT NULL) <> visible) AS confidence_mismatch FROM b GROUP BY clip_id""")
_FAR = "sqrt((pixel_x - {f}(pixel_x) OVER w) * (pixel_x - {f}(pixel_x) OVER w) + (pixel_y - {f}(pixel_y) OVER w) * (pixel_y - {f}(pixel_y) OVER w)) > 150 * abs(frame - {f}(frame) OVER w)"
_add("b2_drop_outliers", lambda get: B.drop_outliers(get("ball").filter("visible"), 150.0), f"""d AS (SELECT *, {_FAR.format(f='lag')} AS back, {_FAR.format(f='lead')} AS ahead FROM fx_ball WHERE visible WINDOW w AS ({_W}))
    SELECT clip_id, frame, visible, interpolated, pixel_x, pixel_y, confidence FROM d WHERE NOT (coalesce(back, true) AND coalesce(ahead, true) AND (back IS NOT NULL OR ahead IS NOT NULL))""")
_add("b3_fill_gaps", lambda get: B.fill_gaps(get("ball")), """v AS (SELECT clip_id, frame, visible, pixel_x, pixel_y, max(CASE WHEN visible THEN frame END) OVER (PARTITION BY clip_id ORDER BY frame) AS fa,
      min(CASE WHEN visible THEN frame END) OVER (PARTITION BY clip_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS fb FROM fx_ball),
    j AS (SELECT v.*, a.pixel_x AS ax, a.pixel_y AS ay, b.pixel_x AS bx, b.pixel_y AS by_, coalesce(NOT v.visible AND fb - fa BETWEEN 2 AND 8, false) AS fill, (v.frame - fa) / (fb - fa) AS t
      FROM v LEFT JOIN fx_ball a ON a.clip_id = v.clip_id AND a.frame = fa LEFT JOIN fx_ball b ON b.clip_id = v.clip_id AND b.frame = fb)
    SELECT clip_id, frame, CASE WHEN visible THEN 'visible' WHEN fill THEN 'interpolated' ELSE 'missing' END AS state, CASE WHEN visible THEN pixel_x WHEN fill THEN ax + (bx - ax) * t END AS x, CASE WHEN visible THEN pixel_y WHEN fill THEN ay + (by_ - ay) * t END AS y FROM j""")
_STEP = "sqrt((pixel_x - lag(pixel_x) OVER w) * (pixel_x - lag(pixel_x) OVER w) + (pixel_y - lag(pixel_y) OVER w) * (pixel_y - lag(pixel_y) OVER w))"
_add("b4_drop_teleports", lambda get: B.drop_teleports(get("ball"), 35.0), f"""b AS (SELECT *, coalesce({_STEP} > 35, false) AS bad FROM fx_ball WINDOW w AS ({_W})), c AS (SELECT *, sum(CASE WHEN bad THEN 0 ELSE 1 END) OVER ({_W}) AS chain FROM b)
    SELECT clip_id, frame, visible, interpolated, pixel_x, pixel_y, confidence, bad AND sum(CAST(bad AS INT)) OVER (PARTITION BY clip_id, chain ORDER BY frame) % 2 = 1 AS dropped FROM c""")
_TURN = "CASE WHEN sqrt({a}*{a}+{b}*{b}) * sqrt({c}*{c}+{d}*{d}) > 0 THEN degrees(acos(greatest(-1, least(1, ({a}*{c}+{b}*{d}) / (sqrt({a}*{a}+{b}*{b}) * sqrt({c}*{c}+{d}*{d})))))) END"
_VEL = f"""st AS (SELECT clip_id, frame, pixel_x - lag(pixel_x) OVER w AS ax, pixel_y - lag(pixel_y) OVER w AS ay, lead(pixel_x) OVER w - pixel_x AS bx, lead(pixel_y) OVER w - pixel_y AS by_ FROM fx_ball WINDOW w AS ({_W})),
    ve AS (SELECT clip_id, frame, sqrt(ax*ax+ay*ay) AS speed_in, sqrt(bx*bx+by_*by_) AS speed_out, round({_TURN.format(a='ax', b='ay', c='bx', d='by_')}, 4) AS turn,
      CASE WHEN greatest(sqrt(ax*ax+ay*ay), sqrt(bx*bx+by_*by_)) > 0 THEN abs(sqrt(ax*ax+ay*ay) - sqrt(bx*bx+by_*by_)) / greatest(sqrt(ax*ax+ay*ay), sqrt(bx*bx+by_*by_)) END AS speed_ratio FROM st WHERE ax IS NOT NULL AND bx IS NOT NULL)"""
_add("b5_velocity", lambda get: B.velocity(get("ball")).withColumn("turn", F.round("turn", 4)), _VEL + " SELECT * FROM ve")
_add("b6_windowed_velocity", lambda get: B.windowed_velocity(get("ball")).withColumn("turn", F.round("turn", 4)), f"""k AS (SELECT * FROM fx_ball WHERE {KNOWN}),
    n AS (SELECT clip_id, frame, pixel_x, pixel_y, lag(frame) OVER w AS fa, lag(pixel_x) OVER w AS xa, lag(pixel_y) OVER w AS ya, lead(frame) OVER w AS fb, lead(pixel_x) OVER w AS xb, lead(pixel_y) OVER w AS yb FROM k WINDOW w AS ({_W})),
    v AS (SELECT clip_id, frame, (pixel_x - xa) / (frame - fa) AS vx_in, (pixel_y - ya) / (frame - fa) AS vy_in, (xb - pixel_x) / (fb - frame) AS vx_out, (yb - pixel_y) / (fb - frame) AS vy_out FROM n WHERE frame - fa <= 5 AND fb - frame <= 5)
    SELECT *, round({_TURN.format(a='vx_in', b='vy_in', c='vx_out', d='vy_out')}, 4) AS turn FROM v""")
_RUNS = f"""kr AS (SELECT clip_id, frame, {KNOWN} AS known FROM fx_ball), ch AS (SELECT *, CASE WHEN known <> lag(known) OVER ({_W}) THEN 1 ELSE 0 END AS change FROM kr), ru AS (SELECT *, sum(change) OVER ({_W}) AS run FROM ch)"""
_add("b7_known_runs", lambda get: B.known_runs(get("ball")), _RUNS + """, o AS (SELECT clip_id, known, min(frame) AS start_frame, max(frame) AS end_frame, count(*) AS length FROM ru GROUP BY clip_id, run, known)
    SELECT *, lag(length) OVER (PARTITION BY clip_id ORDER BY start_frame) AS gap_before FROM o""")
_add("b8_jump_into_run", lambda get: B.jump_into_run(get("ball")), f"""k AS (SELECT clip_id, frame, frame - lag(frame) OVER w AS g, {_STEP} AS d FROM fx_ball WHERE {KNOWN} WINDOW w AS ({_W})) SELECT clip_id, frame, d / g AS jump FROM k WHERE g > 1""")
_add("b9_max_jump", lambda get: B.max_jump(get("ball"), get("ball")), f"""k AS (SELECT clip_id, frame AS f1, lag(frame) OVER w AS f0, {_STEP} / (frame - lag(frame) OVER w) AS step FROM fx_ball WHERE {KNOWN} WINDOW w AS ({_W}))
    SELECT e.clip_id, e.frame, max(step) AS max_jump FROM fx_ball e JOIN k ON k.clip_id = e.clip_id AND f0 >= e.frame - 30 AND f1 <= e.frame + 30 GROUP BY e.clip_id, e.frame""")
_add("b10_grounded_fraction", lambda get: B.grounded_fraction(get("ball"), get("court")), f"""p AS (SELECT clip_id, frame, {KNOWN} AS known, {_PROJ.format(x='pixel_x', y='pixel_y', a='x', b='y')} FROM fx_ball JOIN fx_court USING (clip_id)),
    g AS (SELECT clip_id, frame, CASE WHEN known THEN CAST({_RECT.format(x='x', y='y', s=8, e=8)} AS INT) END AS near_ FROM p)
    SELECT clip_id, frame, CASE WHEN count(near_) OVER w >= 6 THEN avg(near_) OVER w END AS grounded FROM g WINDOW w AS ({_W} RANGE BETWEEN 15 PRECEDING AND 15 FOLLOWING)""")
_add("b11_visibility", lambda get: B.visibility(get("ball")), f"SELECT clip_id, frame, avg(CAST(visible AS INT)) OVER ({_W} RANGE BETWEEN 15 PRECEDING AND 15 FOLLOWING) AS visibility FROM fx_ball")
_add("b11_coverage", lambda get: B.coverage(get("ball")), f"""SELECT clip_id, avg(CAST(visible AS INT)) AS visible_share, avg(CAST(interpolated AS INT)) AS interpolated_share, avg(CAST(NOT {KNOWN} AS INT)) AS none_share, avg(CAST(visible AS INT)) < 0.30 AS low_coverage FROM fx_ball GROUP BY clip_id""")
_add("b12_gap_stats", lambda get: B.gap_stats(get("ball")), f"""c AS (SELECT *, CASE WHEN visible <> lag(visible) OVER ({_W}) THEN 1 ELSE 0 END AS change FROM fx_ball), r AS (SELECT *, sum(change) OVER ({_W}) AS run FROM c),
    n AS (SELECT clip_id, run, count(*) AS n FROM r WHERE NOT visible GROUP BY ALL)
    SELECT clip_id, count(*) AS n_gaps, quantile_cont(n, 0.5) AS median_gap, quantile_cont(n, 0.9) AS p90_gap, max(n) AS longest_gap, count_if(n >= 4) AS long_gaps FROM n GROUP BY clip_id""")
_add("b18_roi_filter", lambda get: B.roi_filter(get("ball"), get("court")), f"""p AS (SELECT clip_id, confidence, {_PROJ.format(x='pixel_x', y='pixel_y', a='x', b='y')} FROM fx_ball JOIN fx_court USING (clip_id) WHERE visible)
    SELECT clip_id, count_if(confidence < 0.3) AS low_confidence, count_if(confidence >= 0.3 AND NOT {_RECT.format(x='x', y='y', s=8, e=8)}) AS outside, count_if(confidence >= 0.3 AND {_RECT.format(x='x', y='y', s=8, e=8)}) AS kept FROM p GROUP BY clip_id""")
_add("b19_live_play_rate", lambda get: B.live_play_rate(get("ball"), get("rallies")), f"""SELECT clip_id, count(*) AS frames, avg(CAST({KNOWN} AS INT)) AS known_share FROM fx_ball b
    WHERE EXISTS (SELECT 1 FROM fx_rallies r WHERE r.clip_id = b.clip_id AND b.frame BETWEEN start_frame AND end_frame) GROUP BY clip_id""")

# ---- shots and bounces
_IMP = _VEL + """, im AS (SELECT clip_id, frame, greatest(turn / 180, least(1, speed_ratio)) AS score FROM ve WHERE greatest(speed_in, speed_out) >= 5 AND (turn >= 45 OR speed_ratio >= 0.35))"""
_add("d1_impulse_candidates", lambda get: D.impulse_candidates(get("ball")).withColumn("score", F.round("score", 3)), _IMP + " SELECT clip_id, frame, round(score, 3) AS score FROM im")
_add("d2_suppress_neighbours", lambda get: H.suppress_neighbours(D.impulse_candidates(get("ball")).withColumn("score", F.round("score", 4)), 5))
_add("d3_associate", lambda get: D.associate(get("ball").filter(B.KNOWN()), get("players"), get("court")), f"""e AS (SELECT b.clip_id, b.frame, track_id, is_user, bbox_y2 - bbox_y1 AS h, sqrt(dx*dx + dy*dy) AS d FROM (
      SELECT b.clip_id, b.frame, p.*, greatest(bbox_x1 - pixel_x, 0, pixel_x - bbox_x2) AS dx, greatest(bbox_y1 - pixel_y, 0, pixel_y - bbox_y2) AS dy
      FROM fx_ball b JOIN fx_players p ON p.clip_id = b.clip_id AND p.frame = b.frame WHERE {KNOWN} AND NOT transient) AS b),
    r AS (SELECT clip_id, frame, min(CASE WHEN d <= least(greatest(0.5 * h, 30), 400) THEN {{'d': d, 'u': NOT is_user, 't': track_id}} END) AS p FROM e GROUP BY ALL) SELECT clip_id, frame, p.t AS track_id, p.d AS distance FROM r""")
_add("d6_same_side_runs", lambda get: D.same_side_runs(get("shots")), """c AS (SELECT *, CASE WHEN hitter_side <> lag(hitter_side) OVER w OR frame - lag(frame) OVER w > 180 THEN 1 ELSE 0 END AS cut FROM fx_shots WINDOW w AS (PARTITION BY clip_id ORDER BY frame, shot_id)),
    r AS (SELECT *, sum(cut) OVER (PARTITION BY clip_id ORDER BY frame, shot_id ROWS UNBOUNDED PRECEDING)::BIGINT AS run FROM c), s AS (SELECT *, max(frame) OVER w - min(frame) OVER w AS span FROM r WINDOW w AS (PARTITION BY clip_id, run))
    SELECT clip_id, shot_id, frame, run, span FROM s QUALIFY row_number() OVER (PARTITION BY clip_id, run ORDER BY CASE WHEN span >= 480 THEN -frame ELSE 0 END, confidence DESC, frame, shot_id) = 1""")
_add("d12_renumber", lambda get: D.renumber(get("shots")), "SELECT clip_id, shot_id, frame, row_number() OVER (PARTITION BY clip_id ORDER BY frame, shot_id) - 1 AS new_id FROM fx_shots")
_add("d12_shot_stats", lambda get: D.shot_stats(get("shots")), "SELECT clip_id, count(*) AS shots, count_if(is_serve) AS serves, count_if(is_volley) AS volleys, count_if(hitter_side = 'near') AS near_shots, avg(confidence) AS mean_confidence FROM fx_shots GROUP BY clip_id")
_BC = f"""ar AS (SELECT clip_id, frame, pixel_y, count(CASE WHEN {KNOWN} THEN 1 END) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS nk, max(pixel_y) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS top,
      min(pixel_y) OVER ({_W} ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING) AS bf, min(pixel_y) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND 4 FOLLOWING) AS af FROM fx_ball),
    bc AS (SELECT clip_id, frame, least(pixel_y - bf, pixel_y - af) AS score FROM ar WHERE pixel_y = top AND pixel_y - bf >= 30 AND pixel_y - af >= 30 AND nk > 0)"""
_add("n1_bounce_candidates", lambda get: D.bounce_candidates(get("ball")), _BC + " SELECT * FROM bc")
_add("n2_exclude_near", lambda get: D.exclude_near(D.bounce_candidates(get("ball")), get("shots")), _BC + " SELECT * FROM bc WHERE NOT EXISTS (SELECT 1 FROM fx_shots s WHERE s.clip_id = bc.clip_id AND abs(s.frame - bc.frame) <= 10)")
_add("n3_suppress_bounces", lambda get: H.suppress_neighbours(D.bounce_candidates(get("ball")), 12))
_add("n5_ground_contact", lambda get: D.ground_contact(D.bounce_candidates(get("ball")), get("ball")), _BC + f""", o AS (SELECT bc.clip_id, bc.frame AS detected, b.frame, row_number() OVER (PARTITION BY bc.clip_id, bc.frame ORDER BY b.pixel_y DESC, b.frame <> bc.frame, b.frame) AS place
      FROM bc JOIN fx_ball b ON b.clip_id = bc.clip_id AND abs(b.frame - bc.frame) <= 3 AND {KNOWN}) SELECT clip_id, detected, frame FROM o WHERE place = 1""")
_add("n7_between_shots", lambda get: D.between_shots(get("bounces"), get("shots")), _LINKED + " SELECT * FROM lk")
_add("n8_cap_per_interval", lambda get: D.cap_per_interval(D.between_shots(get("bounces"), get("shots")).join(get("bounces").select("clip_id", "bounce_id", "confidence"), ["clip_id", "bounce_id"])),
     _LINKED + """ SELECT lk.clip_id, bounce_id, prev_shot, next_shot, confidence FROM lk JOIN fx_bounces b USING (clip_id, bounce_id) QUALIFY row_number() OVER (PARTITION BY lk.clip_id, prev_shot, next_shot ORDER BY confidence DESC, lk.frame, bounce_id) = 1""")
_add("n9_bounce_stats", lambda get: D.bounce_stats(D.bounce_rows(get("bounces"))), _BROWS + " SELECT clip_id, count(*) AS bounces, count_if(is_in) AS n_in, count_if(NOT is_in) AS n_out, " + ", ".join(
    f"count_if(zone = '{z}') AS {z}" for z in ("kitchen", "transition", "baseline")) + ", " + ", ".join(f"count_if(out_side = '{s}') AS out_{s}" for s in ("left", "right", "near", "far")) + " FROM br GROUP BY clip_id")
_add("n10_refractory", lambda get: H.refractory(get("bounces").select(F.col("clip_id").cast("long").alias("clip_id"), F.col("bounce_id").cast("long").alias("bounce_id"), F.col("frame").cast("long").alias("frame")), 60), """b AS (SELECT clip_id, frame, min(bounce_id) AS bounce_id FROM fx_bounces GROUP BY ALL), p AS (SELECT b.clip_id, b.frame, n.frame AS next FROM b ASOF LEFT JOIN b n ON n.clip_id = b.clip_id AND b.frame + 60 < n.frame),
    k(clip_id, frame, next) AS (SELECT clip_id, frame, next FROM p WHERE (clip_id, frame) IN (SELECT (clip_id, min(frame)) FROM b GROUP BY clip_id) UNION ALL SELECT p.* FROM k JOIN p ON p.clip_id = k.clip_id AND p.frame = k.next) SELECT b.clip_id, b.bounce_id, b.frame FROM b JOIN k ON k.clip_id = b.clip_id AND k.frame = b.frame""")
_add("t5_volley_flag", lambda get: D.volley_flag(get("shots"), D.between_shots(get("bounces"), get("shots"))), _LINKED + """, h AS (SELECT DISTINCT clip_id, next_shot AS shot_id FROM lk WHERE next_shot IS NOT NULL),
    f AS (SELECT clip_id, shot_id, is_serve OR row_number() OVER (PARTITION BY clip_id ORDER BY frame, shot_id) = 1 AS fixed FROM fx_shots)
    SELECT f.clip_id, f.shot_id, NOT fixed AND h.shot_id IS NULL AS volley, CASE WHEN fixed THEN 0.9 ELSE 0.4 END AS volley_confidence FROM f LEFT JOIN h ON h.clip_id = f.clip_id AND h.shot_id = f.shot_id""")
_add("t9_classify_stats", lambda get: D.classify_stats(get("shots")), """SELECT clip_id, shot_type, count(*) AS n, count_if(is_volley) AS volleys, count_if(stroke_side = 'forehand') AS forehands, count(*) / sum(count(*)) OVER (PARTITION BY clip_id) AS share FROM fx_shots GROUP BY clip_id, shot_type""")

# ---- rallies and views
_SEG = "sg AS (SELECT * FROM (SELECT *, sum(CAST(is_serve AS INT)) OVER (PARTITION BY clip_id ORDER BY frame, shot_id ROWS UNBOUNDED PRECEDING)::BIGINT - 1 AS rally_id FROM fx_shots) WHERE rally_id >= 0)"
_add("r1_segment_rallies", lambda get: R.segment_rallies(get("shots")).select("clip_id", "shot_id", "rally_id"), _SEG + " SELECT clip_id, shot_id, rally_id FROM sg")
_add("r1_real_ball_rallies", lambda get: R.segment_rallies(get("played"), get("scene_court")).select("clip_id", "shot_id", "rally_id"), """s AS (SELECT p.*, real, row_number() OVER (PARTITION BY p.clip_id ORDER BY frame, shot_id) AS k FROM fx_played p JOIN fx_scene_court USING (clip_id) WHERE NOT (real AND is_between_point))
    SELECT clip_id, shot_id, rally_id FROM (SELECT *, sum(CASE WHEN is_serve OR (real AND k = 1) THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY frame, shot_id)::BIGINT - 1 AS rally_id FROM s) WHERE rally_id >= 0""")
_add("r2_apply_rally_ends", lambda get: R.apply_rally_ends(get("shots"), get("bounces").filter("court_x_ft > 15")), """e AS (SELECT clip_id, frame, NULL AS shot_id, false AS is_serve, true AS is_end FROM fx_bounces WHERE court_x_ft > 15 UNION ALL SELECT clip_id, frame, shot_id, is_serve, false FROM fx_shots),
    m AS (SELECT *, max(CASE WHEN is_end THEN frame END) OVER (PARTITION BY clip_id ORDER BY frame RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS en, max(CASE WHEN is_serve THEN frame END) OVER (PARTITION BY clip_id ORDER BY frame RANGE UNBOUNDED PRECEDING) AS sv FROM e)
    SELECT clip_id, shot_id, coalesce(frame - en <= 900 AND (sv IS NULL OR sv <= en), false) AS between_points FROM m WHERE NOT is_end""")
_add("r3_drop_micro", lambda get: R.drop_micro(get("rallies")).select("clip_id", "rally_id", "n_shots"), "SELECT clip_id, rally_id, n_shots FROM fx_rallies WHERE NOT (n_shots > 1 AND n_shots < 3 AND end_frame - start_frame < 120)")
_PLAYED = lambda get: (get("played"), D.between_shots(get("bounces"), get("played")).join(D.bounce_rows(get("bounces")).select("clip_id", "bounce_id", "is_in", "out_side"), ["clip_id", "bounce_id"]).join(get("bounces").select("clip_id", "bounce_id", F.col("court_y_ft").alias("y")), ["clip_id", "bounce_id"]), get("scene_court"))
_RALLIES = _LINKED.replace("FROM fx_shots)", "FROM fx_played)") + ", " + _BROWS + """,
    ps AS (SELECT p.*, fps, real, row_number() OVER (PARTITION BY p.clip_id ORDER BY frame, shot_id) AS k FROM fx_played p JOIN fx_scene_court USING (clip_id) WHERE NOT (real AND is_between_point)),
    pg AS (SELECT *, sum(CASE WHEN is_serve OR (real AND k = 1) THEN 1 ELSE 0 END) OVER (PARTITION BY clip_id ORDER BY frame, shot_id)::BIGINT - 1 AS g FROM ps),
    pr_ AS (SELECT clip_id, g, any_value(fps) AS fps, any_value(real) AS real, count(*) AS n_shots, min(frame) AS start_frame, max(frame) AS last_frame, list(shot_id ORDER BY frame, shot_id) AS shot_ids, first(struct_pack(i := shot_id, t := track_id, u := is_user, h := hitter_side, s := is_serve) ORDER BY frame, shot_id) AS a,
      last(struct_pack(i := shot_id, h := hitter_side) ORDER BY frame, shot_id) AS z FROM pg WHERE g >= 0 GROUP BY clip_id, g),
    pn AS (SELECT *, row_number() OVER w - 1 AS rally_id, lead(start_frame) OVER w - last_frame AS wait FROM pr_ WHERE NOT (real AND n_shots = 2 AND (last_frame - start_frame) / fps < 2) WINDOW w AS (PARTITION BY clip_id ORDER BY start_frame, g)),
    pb AS (SELECT pn.clip_id, rally_id, count(j.bounce_id) AS post, arg_min(struct_pack(b := j.bounce_id, f := j.frame, i := is_in, y := court_y_ft), j.frame) AS f, arg_max(struct_pack(b := j.bounce_id, f := j.frame, i := is_in, o := out_side, y := court_y_ft, s := side), j.frame) AS l
      FROM pn LEFT JOIN (SELECT lk.*, is_in, out_side, side, court_y_ft FROM lk JOIN br USING (clip_id, bounce_id) JOIN fx_bounces USING (clip_id, bounce_id)) j ON j.clip_id = pn.clip_id AND j.prev_shot = z.i GROUP BY pn.clip_id, rally_id),
    pe AS (SELECT pn.*, post, f, l, CASE WHEN n_shots = 1 THEN 'serve-fault' WHEN post >= 2 THEN 'double-bounce' WHEN l.i AND l.s = z.h THEN 'net-or-short' WHEN post = 1 AND NOT l.i THEN 'ball-out' WHEN l.i THEN 'ball-not-returned' WHEN post = 0 AND wait > 0 AND NOT real THEN 'ball-off-frame' ELSE 'unknown' END AS end_reason,
      CASE WHEN f.y IS NULL THEN false WHEN a.h = 'near' THEN f.y BETWEEN 22 AND 29 ELSE f.y BETWEEN 15 AND 22 END AS short FROM pn JOIN pb USING (clip_id, rally_id)),
    pf AS (SELECT *, CAST(CASE end_reason WHEN 'serve-fault' THEN CASE WHEN NOT f.i OR short THEN 0.9 WHEN wait > 0 AND wait <= 2 * fps THEN 0.7 ELSE 0.5 END WHEN 'double-bounce' THEN 0.85 WHEN 'net-or-short' THEN 0.8 WHEN 'ball-out' THEN 0.85 WHEN 'ball-not-returned' THEN 0.75 WHEN 'ball-off-frame' THEN 0.5 ELSE 0.3 END AS DOUBLE) AS end_confidence,
      CASE WHEN end_reason = 'serve-fault' THEN f.b WHEN end_reason IN ('ball-off-frame', 'unknown') THEN NULL ELSE l.b END AS ending_bounce_id, greatest(last_frame, CASE WHEN end_reason = 'serve-fault' THEN f.f WHEN end_reason IN ('ball-off-frame', 'unknown') THEN NULL ELSE l.f END) AS end_frame FROM pe)"""
_add("r4_rally_end_reason", lambda get: R.rallies_of(*_PLAYED(get)).select("clip_id", "rally_id", "end_reason", "end_confidence", "ending_bounce_id", "signals.*"), _RALLIES + """ SELECT clip_id, rally_id, end_reason, end_confidence, ending_bounce_id, post AS n_bounces_after_last_shot, l.i AS last_bounce_in_court, l.o AS last_bounce_out_side, l.s AS last_bounce_side,
    CASE WHEN l.y IS NULL THEN NULL WHEN a.h = 'near' THEN l.y BETWEEN 22 AND 29 ELSE l.y BETWEEN 15 AND 22 END AS last_bounce_in_kitchen, z.h AS hitter_side, a.h AS server_side, wait AS frames_to_next_serve FROM pf""")
_add("r5_whole_rallies", lambda get: R.rallies_of(*_PLAYED(get)).drop("signals", "real"), _RALLIES + """ SELECT clip_id, rally_id, start_frame, end_frame, round((end_frame - start_frame) / fps, 3) AS seconds, n_shots, shot_ids, a.i AS serve_shot_id, a.t AS server, a.u AS server_is_user, real AND NOT a.s AS serve_is_inferred, z.i AS last_shot,
    end_reason, end_confidence, ending_bounce_id FROM pf""")
_add("r6_rally_counts", lambda get: R.rally_counts(R.rallies_of(*_PLAYED(get)), get("played")), _RALLIES + ", c AS (SELECT clip_id, count(*) AS rallies, " + ", ".join(f"count_if(end_reason = '{r}') AS {r.replace('-', '_')}" for r in R.REASONS) + """, CAST(sum(n_shots) AS BIGINT) AS in_rallies, round(avg(n_shots), 3) AS mean_length,
    round(avg(round((end_frame - start_frame) / fps, 3)), 3) AS mean_seconds FROM pf GROUP BY clip_id) SELECT c.*, n - in_rallies AS unassigned FROM c JOIN (SELECT clip_id, count(*) AS n FROM fx_played GROUP BY clip_id) USING (clip_id)""")
_add("r5_rally_rows", lambda get: R.rally_rows(R.segment_rallies(get("shots"))), _SEG + """ SELECT clip_id, rally_id, min(frame) AS start_frame, max(frame) AS end_frame, (max(frame) - min(frame)) / 60 AS seconds, list(shot_id ORDER BY frame, shot_id) AS shot_ids,
    first(track_id ORDER BY frame, shot_id) AS server, bool_or(is_serve) AS served FROM sg GROUP BY clip_id, rally_id""")
_add("r6_rally_stats", lambda get: R.rally_stats(get("rallies")), "SELECT clip_id, end_reason, count(*) AS rallies, sum(n_shots)::BIGINT AS shots, avg(n_shots) AS mean_length, avg(end_frame - start_frame) AS mean_frames FROM fx_rallies GROUP BY clip_id, end_reason")
_add("r7_longest_dead_run", lambda get: R.longest_dead_run(get("shots"), get("ball")), f"""sp AS (SELECT clip_id, shot_id, frame + 1 AS lo, lead(frame) OVER (PARTITION BY clip_id ORDER BY frame, shot_id) - 1 AS hi FROM fx_shots),
    d AS (SELECT b.clip_id, shot_id, b.frame, b.frame - row_number() OVER (PARTITION BY b.clip_id, shot_id ORDER BY b.frame) AS island FROM fx_ball b JOIN sp ON sp.clip_id = b.clip_id AND b.frame BETWEEN lo AND hi WHERE NOT {KNOWN}),
    r AS (SELECT clip_id, shot_id, island, count(*) AS n FROM d GROUP BY ALL) SELECT clip_id, shot_id, max(n) AS dead_frames FROM r GROUP BY ALL""")
_add("v1_timeline", lambda get: R.timeline(get("rallies"), get("shots"), get("bounces")), """t AS (SELECT clip_id, start_frame AS frame, 'rally_start' AS event, 0 AS rank, rally_id AS ref FROM fx_rallies UNION ALL SELECT clip_id, frame, 'shot', 1, shot_id FROM fx_shots
    UNION ALL SELECT clip_id, frame, 'bounce', 2, bounce_id FROM fx_bounces UNION ALL SELECT clip_id, end_frame, 'rally_end', 3, rally_id FROM fx_rallies) SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY frame, rank, ref) AS place FROM t""")
_add("v2_user_shot_groups", lambda get: R.user_shot_groups(get("shots"), get("roles")), """u AS (SELECT s.*, CASE WHEN seq = 1 THEN 'serves' WHEN seq = 2 THEN 'returns' WHEN seq = 3 THEN 'third_shots' WHEN shot_type IN ('dink', 'drop') THEN shot_type || 's' WHEN is_volley THEN 'volleys' ELSE 'others' END AS "group"
    FROM fx_shots s SEMI JOIN (SELECT * FROM fx_roles WHERE role = 'user') r USING (clip_id, track_id)) SELECT clip_id, "group", count(*) AS n, list(frame ORDER BY frame) AS frames FROM u GROUP BY ALL""")
_add("v3_landing_links", lambda get: R.landing_links(get("bounces"), get("shots"), get("roles")), """SELECT b.clip_id, bounce_id, made_by, shot_type, s.frame AS hit_frame, b.frame AS landed_frame, court_x_ft, court_y_ft FROM fx_bounces b JOIN fx_shots s ON s.clip_id = b.clip_id AND s.shot_id = made_by
    JOIN fx_roles r ON r.clip_id = s.clip_id AND r.track_id = s.track_id WHERE role = 'user'""")
_add("v4_jump_list", lambda get: R.jump_list(get("rallies")), "SELECT clip_id, rally_id, greatest(0, start_frame / 60 - 3) AS seek_sec, (end_frame - start_frame) / 60 > 25 AS likely_merged FROM fx_rallies")

# ---- metrics and ratings
_add("m5_shot_mix", lambda get: M.shot_mix(get("shots"), get("roles")), _MIX + " SELECT * FROM mx")
_add("m3_rally_length", lambda get: M.rally_length(get("rallies")), """SELECT clip_id, count(*) AS rallies, avg(n_shots) AS mean_length, quantile_cont(n_shots, 0.5) AS median_length, max(n_shots) AS max_length, count_if(n_shots = 1) AS len_1, count_if(n_shots BETWEEN 2 AND 4) AS len_2_4,
    count_if(n_shots BETWEEN 5 AND 8) AS len_5_8, count_if(n_shots >= 9) AS len_9_up FROM fx_rallies GROUP BY clip_id""")
_add("m4_end_reasons", lambda get: M.end_reasons(get("rallies")), "SELECT clip_id, end_reason, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY clip_id) AS share FROM fx_rallies GROUP BY clip_id, end_reason")
_add("m6_technique", lambda get: M.technique(get("shots"), get("roles")), "SELECT clip_id, role, stroke_side, count(*) AS n, avg(confidence) AS mean_confidence, avg(CAST(confidence >= 0.6 AS INT)) AS confident_share FROM fx_shots JOIN fx_roles USING (clip_id, track_id) GROUP BY ALL")
_add("m7_third_shots", lambda get: M.third_shots(get("shots")), """t AS (SELECT clip_id, count(*) AS thirds, count_if(shot_type = 'drop') AS drops, count_if(shot_type = 'drive') AS drives FROM fx_shots WHERE seq = 3 GROUP BY clip_id)
    SELECT *, CASE WHEN drops + drives > 0 THEN drops / (drops + drives) END AS drop_rate FROM t""")
_add("m8_bounce_in_out", lambda get: M.bounce_in_out(D.bounce_rows(get("bounces"))), _BROWS + " SELECT clip_id, count_if(is_in) AS n_in, count_if(NOT is_in) AS n_out, avg(CAST(is_in AS INT)) AS in_rate FROM br GROUP BY clip_id")
_add("m8_match_span", lambda get: M.match_span(get("shots"), get("bounces"), get("court")), """u AS (SELECT clip_id, frame FROM fx_shots UNION ALL SELECT clip_id, frame FROM fx_bounces), f AS (SELECT clip_id, max(frame) - min(frame) AS frames FROM u GROUP BY clip_id)
    SELECT clip_id, frames / fps AS seconds FROM f JOIN fx_court USING (clip_id)""")
_add("m9_error_attribution", lambda get: M.error_attribution(get("rallies"), get("shots"), get("roles")).withColumn("confidence", F.round(F.col("confidence") + 1e-7, 5)), """j AS (SELECT r.clip_id, end_confidence, role, role_confidence, CASE WHEN end_reason = 'serve_fault' THEN 'server' WHEN end_reason IN ('ball_out', 'net', 'kitchen_fault') THEN 'hitter' WHEN end_reason = 'double_bounce' THEN 'receiver' ELSE 'unknown' END AS owner
    FROM fx_rallies r LEFT JOIN fx_shots s ON s.clip_id = r.clip_id AND s.shot_id = r.last_shot LEFT JOIN fx_roles o ON o.clip_id = s.clip_id AND o.track_id = s.track_id)
    SELECT clip_id, owner, coalesce(role, 'unattributed') AS role, count(*) AS n, round(avg(end_confidence * coalesce(role_confidence, 0)) + 1e-7, 5) AS confidence FROM j GROUP BY ALL""")
_add("m10_confidence_envelope", lambda get: M.confidence_envelope(M.player_block(get("shots"), get("roles")), "serves", "mean_confidence", "shots").select("clip_id", "role", "metric.*").withColumn("confidence", F.round(F.col("confidence") + 1e-7, 5)),
     """p AS (SELECT clip_id, role, count(*) AS n, count_if(is_serve) AS value, avg(CASE WHEN NOT is_serve THEN confidence END) AS c FROM fx_shots JOIN fx_roles USING (clip_id, track_id) GROUP BY ALL)
    SELECT clip_id, role, value, round(c * n / (n + 8) + 1e-7, 5) AS confidence, n, CASE WHEN n < 8 THEN 'sample_size' ELSE 'source' END AS limited_by FROM p""")
_add("m13_in_rally", lambda get: M.in_rally(get("ball").select("clip_id", "frame"), get("rallies")), "SELECT b.clip_id, frame, min(rally_id) AS rally_id FROM fx_ball b JOIN fx_rallies r ON r.clip_id = b.clip_id AND frame BETWEEN start_frame AND end_frame GROUP BY ALL")
_add("m12_role_positions", lambda get: M.role_positions(get("players"), get("roles")), _POS + " SELECT * FROM po")
_add("m14_position_summary", lambda get: M.position_summary(M.role_positions(get("players"), get("roles"))).withColumns({c: F.round(F.col(c) + 1e-7, 5) for c in ("mean_x", "mean_y")}), _POS + ", z AS (SELECT *, " + _ZONE.format(y="y") + """ AS zn, CASE WHEN least(greatest(x, 0), 20) < 20.0E0/3 THEN 'left' WHEN least(greatest(x, 0), 20) < 40.0E0/3 THEN 'centre' ELSE 'right' END AS lt,
    CASE WHEN x BETWEEN 0 AND 20 AND y BETWEEN 0 AND 22 THEN floor(x / 2) * 100 + floor(y / 2) END AS cell FROM po)
    SELECT clip_id, role, count(*) AS frames, """ + ", ".join(f"avg(CAST(zn = '{k}' AS INT)) AS {k}" for k in ("kitchen", "transition", "baseline")) + ", " + ", ".join(f'avg(CAST(lt = \'{k}\' AS INT)) AS "{k}"' for k in ("left", "centre", "right")) +
     ", round(avg(x) + 1e-7, 5) AS mean_x, round(avg(y) + 1e-7, 5) AS mean_y, count(DISTINCT cell) / 110 AS court_share FROM z GROUP BY clip_id, role")
_add("m15_movement", _moves, _POS + ", " + _MOVE + " SELECT clip_id, role, steps, round(feet, 4) AS feet, rallies, round(feet / rallies, 4) AS feet_per_rally, round(feet / minutes, 4) AS feet_per_minute FROM mt")
_add("m16_team_positioning", lambda get: M.team_positioning(M.role_positions(get("players"), get("roles"))), _POS + f""", t AS (SELECT a.clip_id, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS gap, {_ZONE.format(y='a.y')} = 'kitchen' AND {_ZONE.format(y='b.y')} = 'kitchen' AS both_
      FROM po a JOIN po b ON a.clip_id = b.clip_id AND a.frame = b.frame AND a.role = 'user' AND b.role = 'partner')
    SELECT clip_id, count(*) AS frames, avg(CAST(both_ AS INT)) AS both_kitchen, avg(gap) AS mean_gap, quantile_cont(gap, 0.5) AS median_gap, min(gap) AS min_gap, max(gap) AS max_gap FROM t GROUP BY clip_id""")
_add("m18_heatmap", lambda get: M.heatmap(get("bounces"), "court_x_ft", "court_y_ft", ["clip_id"]), """SELECT clip_id, floor(court_y_ft / 2)::BIGINT AS "row", floor(court_x_ft / 2)::BIGINT AS col, count(*) AS n FROM fx_bounces WHERE court_x_ft >= 0 AND court_x_ft < 20 AND court_y_ft >= 0 AND court_y_ft < 44 GROUP BY ALL""")
_add("m19_player_block", lambda get: M.player_block(get("shots"), get("roles")).withColumn("mean_confidence", F.round(F.col("mean_confidence") + 1e-7, 5)), "SELECT clip_id, role, count(*) AS shots, count_if(is_serve) AS serves, count_if(seq = 2) AS returns, round(avg(CASE WHEN NOT is_serve THEN confidence END) + 1e-7, 5) AS mean_confidence FROM fx_shots JOIN fx_roles USING (clip_id, track_id) GROUP BY ALL")
_add("m20_reconcile", lambda get: M.reconcile(get("shots"), get("roles")), """SELECT s.clip_id, count(*) AS shots, count(role) AS attributed, count(*) - count(role) AS unattributed, true AS balanced FROM fx_shots s LEFT JOIN (SELECT * FROM fx_roles WHERE role <> 'noise') r ON r.clip_id = s.clip_id AND r.track_id = s.track_id GROUP BY ALL""")
_add("q2_score_categories", lambda get: _scored(get), _SCORES + " SELECT * FROM sc")
_add("q4_overall_rating", lambda get: M.overall_rating(_scored(get)).withColumns({c: F.round(F.col(c) + 3e-9, 5) for c in ("rating", "low", "high")}), _SCORES + """, r AS (SELECT clip_id, role, sum(level * weight * confidence) / sum(weight * confidence) AS rating, sum(weight * confidence) AS confidence FROM sc GROUP BY ALL)
    SELECT clip_id, role, round(rating + 3e-9, 5) AS rating, confidence, round_even(rating * 2, 0) / 2 AS band, round(rating - (0.25 + 1.25 * (1 - confidence)) + 3e-9, 5) AS low, round(rating + (0.25 + 1.25 * (1 - confidence)) + 3e-9, 5) AS high, least(5, round_even(rating * 2, 0) / 2 + 0.5) AS next_target FROM r""")
_add("l1_focus_areas", lambda get: M.focus_areas(_scored(get)), _SCORES + """, f AS (SELECT clip_id, role, category, round((4.5 - level) * weight * (0.5 + 0.5 * confidence), 6) AS priority FROM sc WHERE level < 4.5)
    SELECT *, row_number() OVER (PARTITION BY clip_id, role ORDER BY priority DESC, category) AS rank FROM f QUALIFY rank <= 6""")

# ---- collections
_OFF = """pe AS (SELECT clip_id, max(shot_id) + 1 AS ns, max(frame) + 1 AS nf, max(track_id) + 1 AS nt FROM fx_shots GROUP BY clip_id), pr AS (SELECT clip_id, count(*) AS nr FROM fx_rallies GROUP BY clip_id),
    ofs AS (SELECT clip_id % 8 AS collection_id, clip_id, coalesce(sum(ns) OVER w, 0)::BIGINT AS shots_offset, coalesce(sum(nf) OVER w, 0)::BIGINT AS frames_offset, coalesce(sum(nt) OVER w, 0)::BIGINT AS tracks_offset, coalesce(sum(nr) OVER w, 0)::BIGINT AS rallies_offset
      FROM pe JOIN pr USING (clip_id) WINDOW w AS (PARTITION BY clip_id % 8 ORDER BY clip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""
_add("a1_member_offsets", lambda get: A.member_offsets(get("shots"), get("rallies")), _OFF + " SELECT * FROM ofs")
_add("a2_union_streams", lambda get: A.union_streams(get("shots"), A.member_offsets(get("shots"), get("rallies"))), _OFF + """ SELECT collection_id, clip_id AS video_id, frame AS video_frame, shot_id + shots_offset AS shot_id, frame + frames_offset AS frame, track_id + tracks_offset AS track_id, shot_type FROM fx_shots JOIN ofs USING (clip_id)""")
_add("a4_pool_roles", lambda get: A.pool_roles(get("roles")), "SELECT clip_id, CASE WHEN role = 'opp_b' THEN 'opp_a' ELSE role END AS pooled, count(*) AS tracks, avg(role_confidence) AS confidence FROM fx_roles GROUP BY ALL")
_add("a5_check_union", lambda get: A.check_union(get("shots").filter("shot_id % 50 <> 7"), get("bounces"), get("roles")), """s AS (SELECT * FROM fx_shots WHERE shot_id % 50 <> 7), f AS (SELECT clip_id, 'dangling' AS fault FROM fx_bounces b WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.clip_id = b.clip_id AND s.shot_id = b.made_by)
    UNION ALL SELECT clip_id, 'no_role' FROM (SELECT DISTINCT clip_id, track_id FROM s) t WHERE NOT EXISTS (SELECT 1 FROM fx_roles r WHERE r.clip_id = t.clip_id AND r.track_id = t.track_id AND role <> 'noise')) SELECT clip_id, fault, count(*) AS n FROM f GROUP BY ALL""")
_add("a6_worst_case", lambda get: A.worst_case_reliability(get("members")), "SELECT collection_id, NOT bool_and(supported) AS any_unsupported, count(*) AS members, list_sort(list(DISTINCT content_hash)) AS hashes FROM fx_members GROUP BY collection_id")
_add("a7_admit_members", lambda get: A.admit_members(get("members")), """SELECT collection_id, member_id, CASE WHEN NOT supported THEN 'unsupported_venue' WHEN row_number() OVER (PARTITION BY collection_id, content_hash, supported ORDER BY captured_order, member_id) > 1 THEN 'same_content' ELSE 'admitted' END AS decision FROM fx_members""")
_add("a8_version_footnote", lambda get: A.version_footnote(get("members")), "SELECT collection_id, count(DISTINCT pipeline_version) AS versions, count(DISTINCT pipeline_version) > 1 AS mixed FROM fx_members GROUP BY collection_id")

# ---- scoring
_add("e1_score_matches", lambda get: E.score_matches(get("truth"), get("shots").filter("shot_id % 7 <> 3").select("clip_id", F.col("frame").cast("long").alias("frame"), F.col("shot_id").cast("long").alias("got_id"))))
_add("e4_score_types", lambda get: E.score_types(get("shots"), get("truth")), """p AS (SELECT t.clip_id, truth_id, true_type, s.shot_type, abs(s.frame - t.frame) AS d, row_number() OVER (PARTITION BY t.clip_id, truth_id ORDER BY abs(s.frame - t.frame), s.shot_id) AS place
    FROM fx_truth t JOIN fx_shots s ON s.clip_id = t.clip_id AND s.frame BETWEEN t.frame - 60 AND t.frame + 60) SELECT true_type, shot_type AS got_type, count(*) AS n, avg(d) AS mean_distance FROM p WHERE place = 1 GROUP BY ALL""")
_add("e5_score_rally_shots", lambda get: E.score_rally_shots(get("shots"), get("rallies")), """g AS (SELECT r.clip_id, rally_id, count(*) AS got FROM fx_rallies r JOIN fx_shots s ON s.clip_id = r.clip_id AND s.frame BETWEEN start_frame - 60 AND end_frame + 60 GROUP BY ALL)
    SELECT clip_id, rally_id, n_shots AS truth, coalesce(got, 0) AS got, coalesce(got, 0) - n_shots AS delta FROM fx_rallies LEFT JOIN g USING (clip_id, rally_id)""")
_add("e9_detector_validation", lambda get: E.detector_validation(get("ball"), get("labels")), """j AS (SELECT l.clip_id, ball_visible, visible, confidence, CASE WHEN visible AND ball_visible THEN sqrt((pixel_x - label_x) * (pixel_x - label_x) + (pixel_y - label_y) * (pixel_y - label_y)) END AS err FROM fx_labels l LEFT JOIN fx_ball b ON b.clip_id = l.clip_id AND b.frame = l.frame)
    SELECT clip_id, count_if(ball_visible) AS labelled, avg(CASE WHEN ball_visible THEN CAST(coalesce(err <= 10, false) AS INT) END) AS rate_10, avg(CASE WHEN ball_visible THEN CAST(coalesce(err <= 25, false) AS INT) END) AS rate_25,
    count_if(NOT ball_visible AND coalesce(visible AND confidence > 0.5, false)) AS false_positives, quantile_cont(err, 0.5) AS median_error, quantile_cont(err, 0.95) AS p95_error, avg(CASE WHEN ball_visible THEN confidence END) AS mean_confidence_seen FROM j GROUP BY clip_id""")
_SIG = "si AS (SELECT clip_id, avg(CAST(visible AND confidence >= 0.3 AS INT)) AS det_rate, avg(CASE WHEN visible AND confidence >= 0.3 THEN confidence END) AS mean_conf, quantile_cont(CASE WHEN visible AND confidence >= 0.3 THEN confidence END, 0.9) AS p90_conf FROM fx_ball GROUP BY clip_id)"
_add("e11_venue_signals", lambda get: E.venue_signals(get("ball")), _SIG + " SELECT * FROM si")
_add("e12_venue_gate", lambda get: E.venue_gate(E.venue_signals(get("ball"))), _SIG + " SELECT *, CASE WHEN p90_conf < 0.470 THEN 'faint' WHEN det_rate < 0.182 THEN 'rare' ELSE 'ok' END AS gate FROM si")
_add("e16_densify_labels", lambda get: E.densify_labels(get("labels")), """n AS (SELECT *, lead(frame) OVER w AS nf, lead(ball_visible) OVER w AS nv, lead(label_x) OVER w AS nx, lead(label_y) OVER w AS ny FROM fx_labels WINDOW w AS (PARTITION BY clip_id ORDER BY frame)),
    e AS (SELECT *, unnest(range(frame + 1, nf)) AS at_ FROM n WHERE ball_visible AND nv AND nf - frame BETWEEN 2 AND 4) SELECT clip_id, frame, ball_visible, label_x AS x, label_y AS y, false AS interpolated FROM fx_labels UNION ALL SELECT clip_id, at_ AS frame, true AS ball_visible, label_x + (nx - label_x) * ((at_ - frame) / (nf - frame)) AS x, label_y + (ny - label_y) * ((at_ - frame) / (nf - frame)) AS y, true AS interpolated FROM e""")
_LS = "CASE WHEN abs({f}(frame) OVER w - frame) <= 6 THEN sqrt(({f}(label_x) OVER w - label_x) * ({f}(label_x) OVER w - label_x) + ({f}(label_y) OVER w - label_y) * ({f}(label_y) OVER w - label_y)) / abs({f}(frame) OVER w - frame) END"
_add("e18_label_speed", lambda get: E.label_speed(get("labels")), f"SELECT * FROM (SELECT clip_id, frame, greatest({_LS.format(f='lag')}, {_LS.format(f='lead')}) AS speed FROM fx_labels WHERE ball_visible WINDOW w AS (PARTITION BY clip_id ORDER BY frame)) WHERE speed IS NOT NULL")
_add("e20_detection_confusion", lambda get: E.detection_confusion(get("ball"), get("labels")), """j AS (SELECT l.clip_id, ball_visible AS seen, coalesce(visible AND confidence >= 0.5, false) AS said, coalesce(sqrt((pixel_x - label_x) * (pixel_x - label_x) + (pixel_y - label_y) * (pixel_y - label_y)) <= 25, false) AS near_
    FROM fx_labels l JOIN fx_ball b ON b.clip_id = l.clip_id AND b.frame = l.frame) SELECT clip_id, count_if(seen AND said AND near_) AS tp, count_if(seen AND NOT (said AND near_)) AS fn, count_if(NOT seen AND said) AS fp, count_if(NOT seen AND NOT said) AS tn FROM j GROUP BY clip_id""")
_add("e8_alternation_check", lambda get: E.alternation_check(get("shots"), get("roles"), get("court")).withColumns({c: F.round(c, 6) for c in ("legal_gap", "same_team_gap")}), """t AS (SELECT s.clip_id, rally_no, frame, shot_id, fps, CASE WHEN role IN ('user', 'partner') THEN 'near' WHEN role IN ('opp_a', 'opp_b') THEN 'far' END AS team
      FROM fx_shots s JOIN fx_court c ON c.clip_id = s.clip_id LEFT JOIN fx_roles r ON r.clip_id = s.clip_id AND r.track_id = s.track_id),
    p AS (SELECT *, row_number() OVER w AS k, lag(team) OVER w AS b, (frame - lag(frame) OVER w) / fps AS gap FROM t WINDOW w AS (PARTITION BY clip_id, rally_no ORDER BY frame, shot_id))
    SELECT clip_id, count(DISTINCT rally_no) AS rallies, count_if(team IS NOT NULL AND b IS NOT NULL) AS pairs, count_if(team = b) AS same_team, count_if(k > 1 AND (team IS NULL OR b IS NULL)) AS unknown_pairs, count_if(k = 2 AND team IS NOT NULL AND b IS NOT NULL) AS returns,
      count_if(k = 2 AND team = b) AS own_returns, round(quantile_cont(CASE WHEN team <> b THEN gap END, 0.5), 6) AS legal_gap, round(quantile_cont(CASE WHEN team = b THEN gap END, 0.5), 6) AS same_team_gap FROM p GROUP BY clip_id""")
contact_plans.register(_add, _LINKED)
review_plans.register(_add, _SCORES, _SIG, _scored)
coaching_plans.register(_add, _SCORES, _LEVELS, _slowed)


def _raw(name: str, run, sql: str) -> None:
    """``run(spark, get)`` builds a query that writes and reads files on the way."""
    _Q[name] = lambda spark, sf_dir: run(spark, lambda fx, get=fixtures(spark, sf_dir): get(f"fx_{fx}"))
    _S[name] = with_fixtures(_counted(sql))


chain_plans.register(_add, _raw)
role_plans.register(_add)
court_plans.register(_add)
bounce_plans.register(_add)
union_plans.register(_add)
report_plans.register(_add, _PLAYED, _RALLIES)


def flagship(spark, sf_dir: str):
    """Shot mix per clip and role."""
    return _Q["m5_shot_mix"](spark, sf_dir)


def queries() -> dict:
    return dict(_Q)


def oracle_sql() -> dict[str, str]:
    return dict(_S)
