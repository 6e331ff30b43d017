"""Queries on ratings with their evidence and on plans, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import coaching as C
from ..operators import metrics as M
from ..sources.readers import written

_DEEP = "seq = 3 AND NOT is_serve AND shot_type IN ('drop', 'drive') AND pk % 3 <> 0"


def _sourced(c: str, n: str, name: str, factor: str = "1") -> str:
    shrunk = f"(CASE WHEN {n} > 0 THEN {n} / ({n} + 8) ELSE 0 END)"
    return f"coalesce({c}, 0) * {shrunk} * {factor} AS {name}_c, CASE WHEN {shrunk} <= coalesce({c}, 0) THEN 'sample_size' ELSE 'measurement' END AS {name}_w"


def _positioned(name: str) -> str:
    return f"share * frames / (frames + 8) AS {name}_c, CASE WHEN share <= frames / (frames + 8) THEN 'measurement' ELSE 'sample_size' END AS {name}_w"


def register(add, scores: str, levels: dict, slowed) -> None:
    """``scores`` are the CTEs of the ratings (positions, ways, shots with stand-ins for contact and knees, drivers), ``levels`` the
    SQL of each category's level, ``slowed(positions)`` the positions that ways are measured between."""
    def rated(get):
        shots = get("shots", again=True).withColumns({"front": F.expr("CASE WHEN pk % 7 <> 0 THEN CAST(pk % 61 - 20 AS DOUBLE) / 20 END"), "knee": F.expr("CASE WHEN pk % 5 <> 0 THEN pk % 60 END"), "contact_zone": F.expr("CASE pk % 3 WHEN 0 THEN 'kitchen' WHEN 1 THEN 'transition' ELSE 'baseline' END")})
        # Players, rallies and positions inside them serve several metrics: each is written once.
        players = written(get("players").select("clip_id", "track_id", "frame", "transient", "court_x_ft", "court_y_ft"))
        rallies, roles, court = written(get("rallies")), get("roles"), get("court")
        inside = written(M.in_rally(M.role_positions(players, roles), rallies))
        drivers = M.rating_drivers(shots, roles, inside.drop("rally_id"), M.movement_inside(slowed(inside), court), rallies)
        return C.categories(drivers, C.evidence(shots, roles, players, rallies), court.select("clip_id", (F.col("clip_id") % 4 == 0).alias("synthetic")))

    weakest, why = {}, {}
    for k, names in C.EVIDENCE.items():
        known = [(f"coalesce({n}_c, 0)", f"coalesce({n}_w, 'measurement')") for n in names]
        weakest[k] = f"least({', '.join(c for c, _ in known)})"
        why[k] = known[0][1] if len(known) == 1 else f"CASE WHEN {known[0][0]} <= {known[1][0]} THEN {known[0][1]} ELSE {known[1][1]} END"
    values = ", ".join(f"('{k}', {i}, {levels[k]}, {M.WEIGHTS[k]}E0, {weakest[k]}, {why[k]}, {C.EVENTS.get(k, 'CAST(NULL AS BIGINT)')}, "
                       + (f"CASE WHEN {k}_n > 0 THEN {C.STROKE_READ}E0 ELSE {C.STROKE_COUNTED}E0 END" if k in ("forehand", "backhand") else "1.0E0") + ")" for i, k in enumerate(C.EVIDENCE))
    ahead = ", ".join(f"avg(CASE WHEN stroke_side = '{s}' AND front IS NOT NULL THEN CAST(front > 0 AS INT) END) AS {s}_ahead" for s in ("forehand", "backhand"))
    ca = scores + f""", pr AS (SELECT po.* FROM po SEMI JOIN mf ON mf.clip_id = po.clip_id AND mf.role = po.role AND mf.frame = po.frame),
    k2 AS (SELECT clip_id, role, avg(CAST(abs(y - 22) <= 9 AS INT)) AS kitchen, avg(CAST(abs(y - 22) > 9 AND abs(y - 22) < 17 AS INT)) AS transition FROM pr GROUP BY clip_id, role),
    k3 AS (SELECT a.clip_id, avg(CAST(abs(a.y - 22) <= 9 AND abs(b.y - 22) <= 9 AS INT)) AS both_kitchen FROM pr a JOIN pr b ON a.clip_id = b.clip_id AND a.frame = b.frame AND a.role = 'user' AND b.role = 'partner' GROUP BY a.clip_id),
    o1 AS (SELECT clip_id, role, count(*) AS n, avg(confidence) AS c, count(stroke_side) AS ns, avg(CASE WHEN stroke_side IS NOT NULL THEN confidence END) AS sc, count_if(is_volley) AS volleys, avg(CASE WHEN is_volley THEN confidence END) AS vc, count_if(is_serve) AS nv,
      avg(CASE WHEN is_serve THEN confidence END) AS ec, count_if({_DEEP}) AS thirds, avg(CASE WHEN {_DEEP} THEN CAST(shot_type = 'drop' AS INT) END) AS drop_rate, count_if(shot_type = 'dink') AS dinks, count_if(stroke_side = 'forehand') AS forehands, count_if(stroke_side = 'backhand') AS backhands, {ahead}
      FROM sk WHERE role <> 'noise' GROUP BY clip_id, role),
    rc AS (SELECT clip_id, role, round(avg(role_confidence), 6) AS rc FROM fx_roles WHERE role <> 'noise' GROUP BY clip_id, role),
    th AS (SELECT clip_id, {_sourced('avg(confidence)', 'count(*)', 'third')} FROM fx_shots WHERE {_DEEP} GROUP BY clip_id),
    le AS (SELECT clip_id, count(*) / (count(*) + 8) AS length_c, 'sample_size' AS length_w FROM fx_rallies GROUP BY clip_id),
    se AS (SELECT clip_id, role, frame, transient FROM fx_players JOIN fx_roles USING (clip_id, track_id) WHERE role <> 'noise'),
    pl AS (SELECT clip_id, role, {_positioned('position')} FROM (SELECT clip_id, role, avg(CAST(NOT transient AS INT)) AS share, count(*) AS frames FROM se GROUP BY clip_id, role)),
    te AS (SELECT clip_id, {_positioned('team')} FROM (SELECT clip_id, avg(CAST(ok AS INT)) AS share, count(*) AS frames FROM (SELECT clip_id, frame, bool_and(NOT transient) AS ok FROM se WHERE role IN ('user', 'partner') GROUP BY clip_id, frame HAVING count(DISTINCT role) = 2) GROUP BY clip_id)),
    ev AS (SELECT o1.*, position_c, position_w, team_c, team_w, third_c, third_w, length_c, length_w, {_sourced('c', 'n', 'type')}, {_sourced('sc', 'ns', 'side')}, {_sourced('vc', 'volleys', 'volley')}, {_sourced('ec', 'nv', 'serve', 'coalesce(rc, 1)')}
      FROM o1 LEFT JOIN pl USING (clip_id, role) LEFT JOIN rc USING (clip_id, role) LEFT JOIN th USING (clip_id) LEFT JOIN le USING (clip_id) LEFT JOIN te USING (clip_id)),
    dv AS (SELECT dr.* EXCLUDE (thirds, drop_rate, kitchen, transition, both_kitchen), k2.kitchen, k2.transition, k3.both_kitchen, ev.* EXCLUDE (clip_id, role), CASE WHEN serves > 0 THEN coalesce(faults, 0) / serves END AS fault_rate
      FROM dr JOIN ev USING (clip_id, role) LEFT JOIN k2 USING (clip_id, role) LEFT JOIN k3 USING (clip_id)),
    cu AS (SELECT dv.*, u.*, clip_id % 4 = 0 AND u.category <> 'strategy' AS fake FROM dv, LATERAL (VALUES {values}) AS u(category, place, level, weight, least_c, limited_by, events, cap)),
    cb AS (SELECT *, CAST(round(round(least(least_c * CASE WHEN fake THEN {C.SYNTHETIC}E0 ELSE 1.0E0 END, cap), 9), 4) AS DOUBLE) AS confidence FROM cu),
    ca AS (SELECT *, CASE WHEN fake THEN 'synthetic' ELSE 'real' END AS data_source, CASE WHEN confidence >= 0.5 THEN 'measured' WHEN confidence >= 0.1 OR (category <> 'third_shot' AND coalesce(events, 0) > 0) THEN 'partial' ELSE 'not_assessable' END AS coverage FROM cb)"""
    add("q3_category_evidence", lambda get: rated(get).select("clip_id", "role", "category", "level", "confidence", "limited_by", "data_source", "coverage", "events"),
        ca + " SELECT clip_id, role, category, level, confidence, limited_by, data_source, coverage, CAST(events AS BIGINT) AS events FROM ca")
    finding = "CASE category " + " ".join(f"WHEN '{k}' THEN CASE WHEN {v} < {lo} THEN 'low' WHEN {v} >= {hi} THEN 'high' WHEN {v} IS NOT NULL THEN 'mid' END" for k, (v, lo, hi) in C.FINDINGS.items()) + " END"
    drills = "CASE category " + " ".join(f"WHEN '{k}' THEN array_to_string(string_split(concat_ws(',', " + ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in choices) + f"), ',')[1:{C.DRILLS_EACH}], ',')" for k, choices in C.DRILLS.items()) + " END"
    add("l1_improvement_plan", lambda get: C.plan(rated(get)), ca + f""", ov AS (SELECT clip_id, role, coalesce(sum(level * weight * confidence) / nullif(sum(weight * confidence), 0), sum(level * weight) / sum(weight)) AS r FROM ca GROUP BY clip_id, role),
    tg AS (SELECT clip_id, role, CAST(least(5.0, greatest(1.0, least(5.0, round_even(round(r, 9) * 2, 0) / 2)) + 0.5) AS DOUBLE) AS target FROM ov),
    f1 AS (SELECT *, CASE WHEN data_source = 'real' AND (confidence < {C.ASSESSED_FROM} OR coalesce(events < {C.LEAST_EVENTS}, false)) THEN 'not_assessable' WHEN level >= target THEN 'strength' ELSE 'focus' END AS first FROM ca JOIN tg USING (clip_id, role)),
    f2 AS (SELECT *, CASE WHEN first = 'focus' THEN CAST(round(round((target - level) * weight * ({C.UNSURE_PART} + {1 - C.UNSURE_PART} * confidence), 9), 4) AS DOUBLE) END AS priority FROM f1),
    f3 AS (SELECT *, CASE WHEN first = 'focus' THEN row_number() OVER (PARTITION BY clip_id, role, first ORDER BY priority DESC, place) END AS rank FROM f2)
    SELECT clip_id, role, category, level, confidence, limited_by, coverage, CAST(events AS BIGINT) AS events, target, CASE WHEN rank > {C.TOP} THEN 'later' ELSE first END AS route, CASE WHEN first = 'focus' THEN CAST(round(round(target - level, 9), 3) AS DOUBLE) END AS gap, priority, rank,
      CASE WHEN first = 'focus' THEN {finding} END AS finding, CASE WHEN first = 'focus' THEN {drills} END AS drills FROM f3""")
