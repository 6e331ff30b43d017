"""Rallies by their rules, ends of rallies, and bounces from smoothed and reconstructed series."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyspark.operators import bounces, rallies, scoring
from rallyspark.operators.params import scaled_params

SHOTS = "clip_id long, shot_id long, frame long, track_id long, is_user boolean, hitter_side string, is_serve boolean, is_between_point boolean"
BOUNCES = "clip_id long, bounce_id long, frame long, prev_shot long, is_in boolean, out_side string, y double"


def court(spark, real):
    return spark.createDataFrame([(1, 60.0, real)], "clip_id long, fps double, real boolean")


def ended(spark, hits, lands=(), real=True):
    """Rallies of (frame, side, serve[, between]) and bounces (frame, shot, in, y), by rally."""
    shots = spark.createDataFrame([(1, i, f, i % 4, False, side, serve, bool(rest and rest[0])) for i, (f, side, serve, *rest) in enumerate(hits)], SHOTS)
    b = spark.createDataFrame([(1, i, f, shot, inside, None if inside else "far", None if y is None else float(y)) for i, (f, shot, inside, y) in enumerate(lands)], BOUNCES)
    return rallies.rallies_of(shots, b, court(spark, real)).orderBy("rally_id").collect(), shots


@pytest.mark.parametrize("lands, reason, sure, real", [
    ([(150, 2, True, 40)], "net-or-short", 0.8, True),  # the far player's shot lands on the far side
    ([(150, 2, True, 4)], "ball-not-returned", 0.75, True), ([(150, 2, False, 50)], "ball-out", 0.85, True), ([(150, 2, False, -9), (190, 2, True, 30)], "double-bounce", 0.85, True),
    ([(90, 1, True, 4)], "unknown", 0.3, True), ([], "unknown", 0.3, True), ([], "ball-off-frame", 0.5, False), ([(150, 2, None, None)], "unknown", 0.3, True)])
def test_reasons_of_a_rally(spark, lands, reason, sure, real):
    hits = [(0, "far", True), (60, "near", False), (120, "far", False), (900, "near", True), (960, "far", False), (1020, "near", False)]
    got, _ = ended(spark, hits, lands, real)
    r = got[0]
    assert (r.end_reason, r.end_confidence, r.n_shots, r.shot_ids, r.server) == (reason, sure, 3, [0, 1, 2], 0)
    used = [f for f, shot, *_ in lands if shot == 2] if reason not in ("unknown", "ball-off-frame") else []
    assert r.end_frame == max(used + [120]) and (r.ending_bounce_id is None) == (not used) and r.seconds == round((r.end_frame - 0) / 60, 3)
    assert r.signals.frames_to_next_serve == 780 and r.signals.server_side == r.signals.hitter_side == "far"
    assert got[1].end_reason == "unknown" and got[1].signals.frames_to_next_serve is None  # nothing follows the last rally


@pytest.mark.parametrize("lands, after, sure", [([(40, 0, False, 60)], 2000, 0.9), ([(40, 0, True, 25)], 2000, 0.9), ([(40, 0, True, 35)], 100, 0.7), ([(40, 0, True, 35)], 121, 0.5), ([], 120, 0.7), ([], 2000, 0.5), ([(40, 0, True, 35), (70, 0, True, 24)], 2000, 0.5)])
def test_a_lone_serve_is_a_fault(spark, lands, after, sure):
    """Sure where it lands out or short; less so by how soon the next serve comes (120 frames at most)."""
    got, _ = ended(spark, [(0, "near", True), (after, "near", True), (after + 60, "far", False), (after + 120, "near", False)], lands)
    assert (got[0].end_reason, got[0].end_confidence) == ("serve-fault", sure)


def test_real_rallies_start_with_the_first_shot_and_leave_out_what_lies_between(spark):
    hits = [(0, "near", False), (60, "far", False), (120, "near", False), (300, "far", False, True), (600, "near", True), (660, "far", False), (2000, "far", True), (2050, "near", False), (2400, "near", True), (2460, "far", False), (2520, "near", False)]
    got, shots = ended(spark, hits)
    assert [(r.shot_ids, r.serve_is_inferred) for r in got] == [([0, 1, 2], True), ([8, 9, 10], False)]  # two of two shots within a second are no rallies
    counts = rallies.rally_counts(rallies.rallies_of(shots, spark.createDataFrame([], BOUNCES), court(spark, True)), shots).first()
    assert (counts.rallies, counts.in_rallies, counts.unassigned, counts.mean_length) == (2, 6, 5, 3.0)
    clean, _ = ended(spark, hits, real=False)  # a made-up ball: only serves start, short rallies stay
    assert [(r.shot_ids, r.serve_is_inferred) for r in clean] == [([4, 5], False), ([6, 7], False), ([8, 9, 10], False)]


def test_ends_take_the_nearest_sample_and_whole_windows(spark):
    """A bounce far from any sample is placed by the nearest one; a dead ball counts only if its half second lies in the look."""
    shots = spark.createDataFrame([(1, 0, 0, "near", True), (1, 1, 60, "far", False), (1, 2, 2000, "near", True)], "clip_id long, shot_id long, frame long, hitter_side string, is_serve boolean")
    land = spark.createDataFrame([(1, 200)], "clip_id long, frame long")
    ball = lambda *rows: spark.createDataFrame([(1, f, float(x), float(y), float(z)) for f, x, y, z in rows], "clip_id long, frame long, x double, y double, z double")
    ends = lambda b: [(r.frame, r.reason) for r in scoring.rally_ends(shots, b, land).collect()]
    assert ends(ball((100, 30, 10, 0.5), (301, 10, 10, 0.5))) == [(200, "out")] and ends(ball((100, 10, 10, 0.5), (299, 30, 10, 0.5))) == [(200, "out")]
    assert ends(ball((100, 10, 10, 0.5), (300, 30, 10, 0.5))) == [(200, "not-returned")]  # as near: the earlier one
    flight = [(f, 10, 2, 5) for f in range(100, 110)]
    dead = lambda a, b: [(f, 10, 22, 0.2) for f in range(a, b)]
    assert ends(ball(*flight, *dead(250, 300)))[0] == (250, "net")
    assert ends(ball(*flight, *dead(395, 440))) == [(200, "not-returned")]  # dead for half a second only after both looks


def noisy_ball(spark, seed):
    rng, rows = random.Random(seed), []
    for f in range(600):
        seen = rng.random() < 0.75 and not 200 < f < 240 and f > 3
        rows.append((1, f, seen, False, 500.0 if seen else None, float(400 + 60 * np.sin(f / 9) + rng.uniform(-8, 8)) if seen else None))
    return spark.createDataFrame(rows, "clip_id long, frame long, visible boolean, interpolated boolean, pixel_x double, pixel_y double"), rows


@pytest.mark.parametrize("fps", [30.0, 60.0])
def test_smoothed_candidates_and_flips(spark, fps):
    ball, rows = noisy_ball(spark, 4)
    params = scaled_params(spark.createDataFrame([(1, fps, 1920)], "clip_id long, fps double, frame_width int"))
    y = np.array([np.nan if r[5] is None else r[5] for r in rows])
    seen = np.flatnonzero(~np.isnan(y))
    ys = np.convolve(np.interp(np.arange(600), seen, y[seen]), [1 / 3] * 3, "same")
    series = bounces.smoothed(ball, params)
    assert np.allclose([r.ys for r in series.orderBy("frame").collect()], ys)
    w, k = (6, 3) if fps == 30 else (12, 6)
    lows = np.lib.stride_tricks.sliding_window_view(ys, 2 * w + 1)  # row i is the window around i + w
    drop = np.minimum(lows[:, w] - lows[:, :w].min(axis=1), lows[:, w] - lows[:, w + 1:].min(axis=1))
    want = {i + w: d for i, d in enumerate(drop) if lows[i, w] == lows[i].max() and d >= 9 and not np.isnan(y[i + w - 2: i + w + 3]).all()}
    got = {r.frame: r.score for r in bounces.candidates(series).collect()}
    assert got == pytest.approx(want) and len(got) > 5
    flip = {r.frame: r.flip for r in bounces.flips(series).collect()}
    assert flip[0] is None and flip[599] is None
    for f in range(1, 599):
        a, b = max(0, f - k), min(599, f + k)
        assert flip[f] == ((ys[f] - ys[a]) / (f - a) > 0.3 and (ys[b] - ys[f]) / (b - f) < -0.3)


def test_bounces_of_a_made_up_rally(spark):
    """Arcs over 40 frames between strikes, with the floor in the middle; one strike is a volley. At 30 frames a second."""
    points, f = [], 0
    for k in range(6):
        lowest = 700 if k % 2 else 500
        for i in range(40):
            points.append((300 + 8 * (i if k % 2 else 40 - i), (300 + (lowest - 300) * (1 - abs(i - 20) / 20)) if k != 3 else 300 - 2 * min(i, 40 - i)))
    rows = [(1, f, True, False, float(x), float(y)) for f, (x, y) in enumerate(points)]
    ball = spark.createDataFrame(rows, "clip_id long, frame long, visible boolean, interpolated boolean, pixel_x double, pixel_y double")
    shots = spark.createDataFrame([(1, k, 40 * k) for k in range(7)], "clip_id long, shot_id long, frame long")
    h = {f"h{i}{j}": float(i == j) for i in range(3) for j in range(3)} | {"h00": 0.02, "h11": 0.06}
    court = spark.createDataFrame([(1, 30.0, 1920, True, *h.values())], "clip_id long, fps double, frame_width int, real boolean, " + ", ".join(f"{k} double" for k in h))
    box = spark.createDataFrame([(1, f, 5, False, 430.0, 640.0, 480.0, 720.0) for f in range(240)], "clip_id long, frame long, track_id long, transient boolean, bbox_x1 double, bbox_y1 double, bbox_x2 double, bbox_y2 double")
    got = bounces.detect_bounces(ball, box, shots, court).orderBy("frame").collect()
    assert [(r.bounce_id, r.frame, r.prev_shot, r.next_shot) for r in got] == [(0, 20, 0, 1), (1, 60, 1, 2), (2, 100, 2, 3), (3, 180, 4, 5), (4, 220, 5, 6)]
    assert [(r.court_x_ft, r.court_y_ft, r.is_in) for r in got][:2] == [(9.2, 30.0, True), (9.2, 42.0, True)]
    assert [r.at_feet for r in got] == [False, True, False, False, True] and all(0 < r.confidence <= 1 for r in got) and got[1].confidence <= 0.7 and got[1].track_id == 5 and got[0].track_id is None
    assert bounces.detect_bounces(ball, box, shots.limit(0), court).count() == 1  # without strikes the whole clip is one interval
    assert bounces.detect_bounces(ball.limit(0), box, shots, court).count() == 0


def test_heights_touch_the_floor(spark):
    """Balls dropped from 4 ft that lose some height at every contact, and one that only skims."""
    rows, f, want = [], 0, []
    for peak in (4.0, 2.2, 1.2, 0.4):
        for t in np.linspace(-1, 1, 41)[:-1]:
            rows.append((1, f, 5.0, 10.0, float(peak * (1 - t * t))))
            f += 1
        want.append(f)
    rows += [(1, f + i, 5.0, 10.0, 0.1 * i) for i in range(40)]
    got = bounces.bounces_from_height(spark.createDataFrame(rows, "clip_id long, frame long, x double, y double, z double"), spark.createDataFrame([(1, 60.0)], "clip_id long, fps double"))
    assert sorted(r.frame for r in got.collect()) == want[:2]  # what follows the third contact stays too low
    near = bounces.bounces_from_height(spark.createDataFrame(rows, "clip_id long, frame long, x double, y double, z double"), spark.createDataFrame([(1, 30.0 * 5)], "clip_id long, fps double"))
    assert sorted(r.frame for r in near.collect()) == want[:1]  # closer than 0.3 s at 150 frames a second
    assert got.filter(F.col("z_ft") > 0.35).count() == 0


def test_windows_of_seconds_take_frames_beyond_2147(spark):
    """Frames counted in ints, as row_number() gives them, in a clip of more than 2,147 frames."""
    rows = spark.range(4000).select(F.lit(1).cast("long").alias("clip_id"), F.col("id").cast("int").alias("frame"), F.lit(True).alias("visible"), F.lit(False).alias("interpolated"), (600 - 30 * F.abs(F.col("id") % 40 - 20)).cast("double").alias("pixel_y"))
    court_ = spark.createDataFrame([(1, 30.0, 1920)], "clip_id long, fps double, frame_width int")
    series = bounces.smoothed(rows, scaled_params(court_))
    assert sorted(r.frame for r in bounces.candidates(series).collect()) == list(range(20, 4000, 40))
    assert sorted(r.frame for r in bounces.flips(series).filter("flip").collect()) == [f for f in range(3960) if f % 40 in (19, 20, 21)] + [3979, 3980, 3981]
