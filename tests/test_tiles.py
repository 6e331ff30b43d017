"""Spans and reaches meet rows by tiles of frames: long ones cost tiles, not frames, and rows at a tile's ends lose nothing."""

import random

import pytest

from rallyspark.operators import ball, evaluation, review, scoring
from rallyspark.operators.tiles import TILE

LONG = 3_000_000_000


def _rallies(spark, rows):
    return spark.createDataFrame(rows, "clip_id long, rally_id long, start_frame long, end_frame long, n_shots long")


def _frames(k):
    rnd = random.Random(k)
    return [(c, rnd.choice((TILE, 3 * TILE)) + rnd.randrange(-400, 400)) for c in (1, 2) for _ in range(150)] + [(1, None)]


def test_shots_of_windows_by_tiles(spark):
    spans = [(c, i, s, s + n, 2) for i, (c, s, n) in enumerate([(1, TILE - 300, 250), (1, TILE + 60, 10), (2, TILE - 200, 2 * TILE), (2, 5 * TILE, -1000), (1, 10, 5), (2, 0, LONG)])]
    shots = _frames(1)
    got = evaluation.score_rally_shots(spark.createDataFrame(shots, "clip_id long, frame long"), _rallies(spark, spans)).collect()
    want = {(c, i): sum(x == c and f is not None and s - 60 <= f <= e + 60 for x, f in shots) for c, i, s, e, _ in spans}
    assert {(r.clip_id, r.rally_id): r.got for r in got} == want and all(r.delta == r.got - r.truth for r in got) and sum(want.values())


def test_impacts_near_tiles_ends(spark):
    a, b = _frames(2), _frames(3)
    truth = spark.createDataFrame([(*r, "serve" if i % 3 else "drive") for i, r in enumerate(a)], "clip_id long, frame long, true_type string")
    shots = spark.createDataFrame([(*r, i % 2 == 0) for i, r in enumerate(b)], "clip_id long, frame long, is_serve boolean")
    near = lambda x, others, n: x[1] is not None and any(o[1] is not None and o[0] == x[0] and abs(o[1] - x[1]) <= n for o in others)
    for within in (0, 6, LONG):
        got = {(r.clip_id, r.kind): (r.n_true, r.found, r.n_got, r.right) for r in review.impact_report(shots, truth, within).collect()}
        for (clip, kind), values in got.items():
            t = [r for i, r in enumerate(a) if r[0] == clip and (kind == "serve") == (i % 3 > 0)]
            s = [r for i, r in enumerate(b) if r[0] == clip and (kind == "serve") == (i % 2 == 0)]
            assert values == (len(t), sum(near(r, b, within) for r in t), len(s), sum(near(r, a, within) for r in s))
        assert len(got) == 4


@pytest.fixture
def spans():
    return [(1, 0, TILE - 250, TILE - 200, 1), (1, 1, TILE - 230, TILE - 220, 1), (1, 2, TILE - 100, TILE + 50, 1), (1, 3, 3 * TILE + 10, 3 * TILE + 9, 1), (2, 0, TILE + 7, LONG, 1)]


def _inside(row, spans):
    return row[1] is not None and any(c == row[0] and s <= row[1] <= e for c, _, s, e, _ in spans)


def test_bounces_in_long_spans(spark, spans):
    rows = _frames(4)
    got = {r.clip_id: (r.inside, r.outside) for r in review.in_play_bound(spark.createDataFrame(rows, "clip_id long, frame long"), _rallies(spark, spans)).collect()}
    assert got == {c: tuple(sum(r[0] == c and _inside(r, spans) == yes for r in rows) for yes in (True, False)) for c in (1, 2)}


def test_known_frames_in_long_spans(spark, spans):
    rows = [(*r, i % 3 == 0, False) for i, r in enumerate(_frames(5))]
    got = {r.clip_id: (r.frames, r.known_share) for r in ball.live_play_rate(spark.createDataFrame(rows, "clip_id long, frame long, visible boolean, interpolated boolean"), _rallies(spark, spans)).collect()}
    held = {c: [r[2] for r in rows if r[0] == c and _inside(r, spans)] for c in (1, 2)}
    assert got == {c: (len(v), pytest.approx(sum(v) / len(v))) for c, v in held.items()}


def test_labels_find_shots_near_tiles_ends(spark):
    rnd = random.Random(6)
    shots = [(c, i, f, rnd.choice(("dink", "Drive")), i % 2 == 0) for i, (c, f) in enumerate((c, TILE + rnd.randrange(-30, 30)) for c in (1, 2) for _ in range(25))] + [(1, 99, None, "lob", True)]
    labels = [(c, i, None if i == 3 else TILE + rnd.randrange(-30, 30), i % 3 == 0, rnd.choice(("dink", "drive", "")), rnd.choice((None, "a feed")), rnd.choice(("y", "N", None))) for c in (1, 2) for i in range(40)]
    df = scoring.typed_labels(spark.createDataFrame(shots, "clip_id long, shot_id long, frame long, shot_type string, is_volley boolean"),
                              spark.createDataFrame(labels, "clip_id long, label_id long, frame long, by_clock boolean, true_type string, notes string, true_volley string"))
    want = {}
    for c, i, at, clock, kind, notes, volley in labels:
        if kind or notes:
            near = min(((abs(s[2] - at), s[2], s[1], s) for s in shots if s[0] == c and None not in (at, s[2]) and abs(s[2] - at) <= 3 + clock), default=None)
            said, flew = (near[3][3].lower(), near[3][4]) if near else ("not-detected", False)
            want[c, i] = (bool(kind), kind, said, (volley == "y") == flew if kind and volley else None)
    assert {(r.clip_id, r.label_id): (r.is_shot, r.truth, r.said, r.volley_right) for r in df.collect()} == want
    plan = df._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan  # labels aren't spread over frames and joined
