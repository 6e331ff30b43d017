"""Queries on clicks, seeds and roles of tracks, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import roles as L
from ..sources.readers import written

_TRACKS = """tk AS (SELECT p.clip_id, track_id, any_value(fps) AS fps, count(*) AS n, min(frame) AS fa, max(frame) AS fb, arg_min(court_x_ft, frame) AS ax, arg_min(court_y_ft, frame) AS ay, arg_max(court_x_ft, frame) AS bx, arg_max(court_y_ft, frame) AS by_,
      quantile_cont(court_x_ft, 0.5) AS mx, quantile_cont(court_y_ft, 0.5) AS my, avg(CAST(is_user AS INT)) AS us, avg(CAST(coalesce(court_x_ft BETWEEN -5 AND 25 AND court_y_ft BETWEEN -15 AND 59, false) AS INT)) AS inside, list(frame) AS frames,
      quantile_cont(bbox_y2 - bbox_y1, 0.75) / (any_value(near_px_per_ft) + (any_value(far_px_per_ft) - any_value(near_px_per_ft)) * least(greatest(quantile_cont(court_y_ft, 0.5) / 44, 0), 1)) AS h
      FROM fx_people p JOIN fx_scene USING (clip_id) GROUP BY p.clip_id, track_id),
    ts AS (SELECT tk.*, CAST(signature AS DOUBLE[]) AS look, CASE WHEN (fb - fa + 1) / fps < 1 OR NOT (mx BETWEEN -5 AND 25 AND my BETWEEN -15 AND 59) OR inside < 0.15 THEN 'noise' WHEN my < 22 THEN 'near' ELSE 'far' END AS side FROM tk LEFT JOIN fx_looks USING (clip_id, track_id))"""
_SEEDS = """ck AS (SELECT clip_id, track_id, CAST(0.95 AS DOUBLE) AS confidence, 'click' AS basis FROM ts WHERE side = 'near' AND us > 0),
    ea AS (SELECT p.clip_id, track_id, quantile_cont(court_x_ft, 0.5) AS ex FROM fx_people p JOIN fx_scene s USING (clip_id) JOIN (SELECT clip_id, min(frame) AS f0 FROM fx_people GROUP BY clip_id) m USING (clip_id) WHERE frame <= f0 + 12 * fps GROUP BY ALL),
    ne AS (SELECT ts.clip_id, ts.track_id, user_corner, mx, ex, count(ex) OVER (PARTITION BY ts.clip_id) = 0 AS late FROM ts JOIN fx_scene USING (clip_id) LEFT JOIN ea ON ea.clip_id = ts.clip_id AND ea.track_id = ts.track_id WHERE side = 'near' AND ts.clip_id NOT IN (SELECT clip_id FROM ck)),
    nr AS (SELECT *, CASE WHEN late THEN mx ELSE ex END AS at_ FROM ne WHERE CASE WHEN late THEN mx ELSE ex END IS NOT NULL),
    nw AS (SELECT *, row_number() OVER w AS place, abs(at_ - lead(at_) OVER w) AS apart FROM nr WINDOW w AS (PARTITION BY clip_id ORDER BY CASE WHEN user_corner = 'left' THEN at_ ELSE -at_ END, track_id)),
    sd AS (SELECT * FROM ck UNION ALL SELECT clip_id, track_id, CASE WHEN apart IS NULL THEN 0.7 WHEN apart < 2 THEN 0.5 ELSE least(0.9, 0.5 + 0.4 * least(1, apart / 20)) END, CASE WHEN late THEN 'overall corner' ELSE 'opening corner' END FROM nw WHERE place = 1)"""


def _cues(p: str) -> str:
    """Score of the track t against the person whose state columns begin with ``p``, with and without looks."""
    tall = f"CASE WHEN t.h IS NULL OR {p}h IS NULL THEN 0.5 ELSE greatest(0, 1 - abs(t.h - {p}h) / 0.9) END"
    near = lambda gap, far: f"CASE WHEN {gap} BETWEEN 0 AND 4 AND {far} <= 12 THEN (1 - {gap} / 4) * (1 - {far} / 12) ELSE 0 END"
    one = near("((t.fa - u.fb) / t.fps)", "sqrt((u.bx - t.ax) * (u.bx - t.ax) + (u.by_ - t.ay) * (u.by_ - t.ay))")
    two = near("((u.fa - t.fb) / t.fps)", "sqrt((t.bx - u.ax) * (t.bx - u.ax) + (t.by_ - u.ay) * (t.by_ - u.ay))")
    return f"list_max(list_prepend(CAST(0 AS DOUBLE), [greatest({one}, {two}) FOR u IN {p}t])) AS {p}follow, {tall} AS {p}tall, CASE WHEN {p}l IS NOT NULL AND t.look IS NOT NULL THEN list_cosine_similarity(t.look, {p}l) END AS {p}look"


_PLACES = "{'fa': fa, 'fb': fb, 'ax': ax, 'ay': ay, 'bx': bx, 'by_': by_}"


def _walk(side: str, cap: float) -> str:
    """Recursive CTE w_<side>: a row per step with the two people x and y (frames f, tracks t, look l, height h) and the verdict
    on the step's track. o_<side> has the tracks in the order of their starts, c_<side> the state before the first."""
    near = side == "near"
    overlap = lambda p: f"len(list_intersect(t.frames, {p}f)) / greatest(1, t.n) > 0.30"
    both, fixed = "false" if near else "with_x AND with_y", "with_x" if near else "((with_x AND has_y) OR with_y)"
    verdict = "CASE WHEN with_x THEN 'y' WHEN sx >= sy THEN 'x' ELSE 'y' END" if near else "CASE WHEN with_x AND with_y THEN 'none' WHEN with_x AND has_y THEN 'y' WHEN with_y OR NOT has_y OR sx >= sy THEN 'x' ELSE 'y' END"
    score = lambda p: f"CASE WHEN xlook IS NOT NULL AND ylook IS NOT NULL THEN 0.60 * {p}look + 0.25 * {p}tall + 0.15 * {p}follow ELSE 0.6 * {p}follow + 0.4 * {p}tall END AS s{p}"
    seen = "'seen beside the user'" if near else "CASE WHEN with_x THEN 'seen beside opp_a' ELSE 'seen beside opp_b' END"
    learn = lambda p, c, v: f"{p}{c}" if near and p == "x" else f"CASE WHEN v = '{p}' THEN coalesce({p}{c}, {v}) ELSE {p}{c} END"
    state = lambda p: f"CASE WHEN v = '{p}' THEN list_concat({p}f, frames) ELSE {p}f END, CASE WHEN v = '{p}' THEN list_append({p}t, {_PLACES}) ELSE {p}t END, {learn(p, 'l', 'look')}, {learn(p, 'h', 'h')}"
    people = ", ".join(p + c for p in "xy" for c in "ftlh")
    return f"""w_{side}(clip_id, k, has_y, {people}, track_id, v, confidence, basis) AS (
      SELECT clip_id, CAST(0 AS BIGINT), has_y, {people}, CAST(NULL AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS DOUBLE), CAST(NULL AS VARCHAR) FROM c_{side}
      UNION ALL SELECT clip_id, k, has_y, {state('x')}, {state('y')}, track_id, v, confidence, basis FROM (
        SELECT *, {verdict} AS v, CAST(CASE WHEN {both} THEN 0.8 WHEN {fixed} THEN {0.8 if near else 0.6} ELSE round(least({cap}, 0.5 + abs(sx - sy)), 3) END AS DOUBLE) AS confidence,
          CASE WHEN {both} THEN 'third person' WHEN {fixed} THEN {seen} WHEN xlook IS NOT NULL AND ylook IS NOT NULL THEN 'look and height' ELSE 'continuity and height' END AS basis
        FROM (SELECT *, {score('x')}, {score('y')} FROM (
          SELECT w.clip_id, w.k + 1 AS k, has_y, {people}, t.track_id, t.frames, t.look, t.h, t.fa, t.fb, t.ax, t.ay, t.bx, t.by_, {overlap('x')} AS with_x, {'false' if near else 'has_y AND ' + overlap('y')} AS with_y, {_cues('x')}, {_cues('y')}
          FROM w_{side} w JOIN o_{side} t ON t.clip_id = w.clip_id AND t.k = w.k + 1))))"""


def register(add) -> None:
    add("p5_click_segments", lambda get: L.click_segments(get("people"), get("clicks")), """m AS (SELECT clip_id, track_id, frame AS f0, row_number() OVER w - 1 AS segment, coalesce(lead(frame) OVER w, 1000000000) AS f1 FROM fx_clicks WINDOW w AS (PARTITION BY clip_id ORDER BY frame, click_id)),
    r AS (SELECT DISTINCT p.clip_id, segment, frame, p.track_id, f0 FROM m JOIN fx_people p ON p.clip_id = m.clip_id AND p.track_id = m.track_id AND frame >= f0 AND frame < f1),
    l AS (SELECT *, CASE WHEN frame - coalesce(lag(frame) OVER w, f0) > 31 THEN 1 ELSE 0 END AS lost FROM r WINDOW w AS (PARTITION BY clip_id, segment ORDER BY frame))
    SELECT clip_id, segment, frame, track_id FROM l QUALIFY max(lost) OVER (PARTITION BY clip_id, segment ORDER BY frame) = 0""")
    add("p5_click_gaps", lambda get: L.click_gaps(L.click_segments(get("people"), get("clicks")), get("people"), get("clicks")), """m AS (SELECT clip_id, track_id, frame AS f0, row_number() OVER w - 1 AS segment, lead(frame) OVER w AS f1 FROM fx_clicks WINDOW w AS (PARTITION BY clip_id ORDER BY frame, click_id)),
    e AS (SELECT clip_id, max(frame) + 1 AS e FROM fx_people GROUP BY clip_id), r AS (SELECT m.clip_id, segment, f0, coalesce(f1, e) AS f1, frame FROM m JOIN e USING (clip_id) LEFT JOIN fx_people p ON p.clip_id = m.clip_id AND p.track_id = m.track_id AND frame >= f0 AND frame < coalesce(f1, e)),
    l AS (SELECT *, CASE WHEN frame - coalesce(lag(frame) OVER w, f0) > 31 THEN 1 ELSE 0 END AS lost FROM r WINDOW w AS (PARTITION BY clip_id, segment ORDER BY frame)),
    k AS (SELECT *, max(lost) OVER (PARTITION BY clip_id, segment ORDER BY frame) AS gone FROM l), s AS (SELECT clip_id, segment, any_value(f0) AS f0, any_value(f1) AS f1, max(CASE WHEN gone = 0 THEN frame END) AS seen FROM k GROUP BY clip_id, segment)
    SELECT clip_id, segment, coalesce(seen, f0) AS last_user_frame, coalesce(seen, f0) + 31 AS resumes_at_or_after FROM s WHERE coalesce(seen, f0) + 31 < f1""")
    tracks = lambda get: L.track_rows(get("people"), get("scene"), get("looks"))
    seeds = lambda get, of: L.seed_user(of, get("people"), get("scene"))

    def roles(get):
        of = written(tracks(get))  # held against one another in several steps
        return L.assign_roles(of, seeds(get, of))

    add("p8_seed_user_tracks", lambda get: seeds(get, written(tracks(get))).withColumn("confidence", F.round("confidence", 6)), _TRACKS + ", " + _SEEDS + " SELECT clip_id, track_id, round(confidence, 6) AS confidence, basis FROM sd")
    add("p11_assign_roles", roles, ROLES_SQL + " SELECT * FROM ro")
    add("p12_role_coverage", lambda get: L.role_coverage(get("people"), roles(get)), ROLES_SQL + """ SELECT p.clip_id, count(DISTINCT p.track_id) AS tracks, count(DISTINCT CASE WHEN role <> 'noise' THEN p.track_id END) AS assigned, count(DISTINCT CASE WHEN role = 'noise' THEN p.track_id END) AS noise,
      count(DISTINCT CASE WHEN role = 'user' THEN frame END) / (max(frame) + 1) AS user_coverage, count(DISTINCT CASE WHEN is_user THEN frame END) / (max(frame) + 1) AS click_coverage FROM fx_people p LEFT JOIN ro ON ro.clip_id = p.clip_id AND ro.track_id = p.track_id GROUP BY p.clip_id""")


def _roles_sql() -> str:
    """The roles by recursion over the tracks of each side, in the order of their starts."""
    overlap = lambda frames, n, other: f"len(list_intersect({frames}, {other})) / greatest(1, {n}) > 0.30"
    return _TRACKS + ", " + _SEEDS + f""",
    sl AS (SELECT clip_id, list(m ORDER BY i) AS look FROM (SELECT clip_id, i, avg(x) AS m FROM (SELECT clip_id, unnest(look) AS x, unnest(range(len(look))) AS i FROM ts JOIN sd USING (clip_id, track_id)) GROUP BY clip_id, i) GROUP BY clip_id),
    us AS (SELECT clip_id, flatten(list(frames)) AS f, list({_PLACES}) AS t, sum(h * n) / sum(CASE WHEN h IS NOT NULL THEN n END) AS h FROM ts JOIN sd USING (clip_id, track_id) GROUP BY clip_id),
    nr_ AS (SELECT ts.* FROM ts ANTI JOIN sd USING (clip_id, track_id) WHERE side = 'near' AND clip_id IN (SELECT clip_id FROM us)),
    pa AS (SELECT nr_.* FROM nr_ JOIN us USING (clip_id) WHERE {overlap('frames', 'n', 'us.f')} QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY n DESC, track_id) = 1),
    c_near AS (SELECT us.clip_id, false AS has_y, us.f AS xf, us.t AS xt, sl.look AS xl, us.h AS xh, CAST([] AS BIGINT[]) AS yf, CASE WHEN pa.track_id IS NULL THEN [] ELSE [{{'fa': pa.fa, 'fb': pa.fb, 'ax': pa.ax, 'ay': pa.ay, 'bx': pa.bx, 'by_': pa.by_}}] END AS yt, pa.look AS yl, pa.h AS yh
      FROM us LEFT JOIN sl USING (clip_id) LEFT JOIN pa ON pa.clip_id = us.clip_id),
    o_near AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY fa, track_id) AS k FROM nr_),
    fa_ AS (SELECT * FROM ts WHERE side = 'far' QUALIFY row_number() OVER (PARTITION BY clip_id ORDER BY n DESC, track_id) = 1),
    fb_ AS (SELECT ts.* FROM ts JOIN fa_ a ON a.clip_id = ts.clip_id AND a.track_id <> ts.track_id WHERE ts.side = 'far' AND {overlap('ts.frames', 'ts.n', 'a.frames')} QUALIFY row_number() OVER (PARTITION BY ts.clip_id ORDER BY ts.n DESC, ts.track_id) = 1),
    c_far AS (SELECT a.clip_id, b.track_id IS NOT NULL AS has_y, a.frames AS xf, [{{'fa': a.fa, 'fb': a.fb, 'ax': a.ax, 'ay': a.ay, 'bx': a.bx, 'by_': a.by_}}] AS xt, a.look AS xl, a.h AS xh, coalesce(b.frames, CAST([] AS BIGINT[])) AS yf,
      CASE WHEN b.track_id IS NULL THEN [] ELSE [{{'fa': b.fa, 'fb': b.fb, 'ax': b.ax, 'ay': b.ay, 'bx': b.bx, 'by_': b.by_}}] END AS yt, b.look AS yl, b.h AS yh FROM fa_ a LEFT JOIN fb_ b ON b.clip_id = a.clip_id),
    o_far AS (SELECT *, row_number() OVER (PARTITION BY clip_id ORDER BY fa, track_id) AS k FROM (SELECT ts.* FROM ts ANTI JOIN (SELECT clip_id, track_id FROM fa_ UNION ALL SELECT clip_id, track_id FROM fb_) USING (clip_id, track_id) WHERE side = 'far')),
    {_walk('near', 0.95)}, {_walk('far', 0.75)},
    ro AS (SELECT clip_id, track_id, 'user' AS role, round(confidence, 3) AS confidence, basis FROM sd UNION ALL SELECT clip_id, track_id, CASE v WHEN 'x' THEN 'user' ELSE 'partner' END, confidence, basis FROM w_near WHERE k > 0
      UNION ALL SELECT clip_id, track_id, CASE v WHEN 'x' THEN 'opp_a' WHEN 'y' THEN 'opp_b' ELSE 'noise' END, confidence, basis FROM w_far WHERE k > 0 UNION ALL SELECT clip_id, track_id, 'opp_a', 0.6, 'longest' FROM fa_ UNION ALL SELECT clip_id, track_id, 'opp_b', 0.6, 'seen beside opp_a' FROM fb_
      UNION ALL SELECT clip_id, track_id, 'noise', 0.9, 'short or outside' FROM ts WHERE side = 'noise')"""


ROLES_SQL = _roles_sql()
