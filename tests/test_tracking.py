"""Small hand-made cases and laws for the tracking operators."""

import random

import duckdb
import pandas as pd
import pytest

from rallyspark.operators import ball, collections_, helpers, metrics, rallies, shots, trajectory
from rallyspark.plans import registry

SF = "/root/testdata/sf0.001"


def ball_of(spark, points):
    rows = [(1, i, p is not None, False, float(p[0]) if p else None, float(p[1]) if p else None, 0.9 if p else None) for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "clip_id long, frame long, visible boolean, interpolated boolean, pixel_x double, pixel_y double, confidence double")


def test_fill_gaps_interpolates_short_gaps_only(spark):
    got = {r.frame: (r.state, r.x) for r in ball.fill_gaps(ball_of(spark, [(0, 0), None, (2, 0)] + [None] * 9 + [(12, 0)])).collect()}
    assert got[1] == ("interpolated", 1.0) and got[5] == ("missing", None) and got[12] == ("visible", 12.0)


def test_drop_teleports_keeps_a_frame_after_a_dropped_one(spark):
    rng = random.Random(4)
    points = [None if rng.random() < 0.1 else (rng.choice([0, 500, 1000]), 0) for _ in range(200)]
    kept, dropped = {}, set()
    for i, p in enumerate(points):  # the rule as a plain loop
        if p and i - 1 in kept and abs(p[0] - kept[i - 1][0]) > 300:
            dropped.add(i)
        elif p:
            kept[i] = p
    assert {r.frame for r in ball.drop_teleports(ball_of(spark, points)).filter("dropped").collect()} == dropped


def test_suppression_matches_a_plain_loop(spark):
    rng = random.Random(1)
    rows = [(c, f, round(rng.random(), 2)) for c in range(3) for f in sorted(rng.sample(range(400), 120))]
    expect = set()
    for c in range(3):
        taken = []
        for _, f, s in sorted((r for r in rows if r[0] == c), key=lambda r: (-r[2], r[1])):
            if all(abs(f - t) > 6 for t in taken):
                taken.append(f)
                expect.add((c, f))
    got = helpers.suppress_neighbours(spark.createDataFrame(rows, "clip_id long, frame long, score double"), 6).collect()
    assert {(r.clip_id, r.frame) for r in got} == expect


def test_match_one_to_one_is_exclusive_and_closest_first(spark):
    truth = spark.createDataFrame([(1, 10, 0), (1, 14, 1), (1, 90, 2)], "clip_id long, frame long, truth_id long")
    got = spark.createDataFrame([(1, 13, 7), (1, 200, 8)], "clip_id long, frame long, got_id long")
    assert [tuple(r) for r in helpers.match_one_to_one(truth, got, 5).collect()] == [(1, 1, 7, 1)]


def test_between_shots_is_strict(spark):
    b = spark.createDataFrame([(1, 0, 10), (1, 1, 15)], "clip_id long, bounce_id long, frame long")
    s = spark.createDataFrame([(1, 5, 10), (1, 6, 20)], "clip_id long, shot_id long, frame long")
    got = {r.bounce_id: (r.prev_shot, r.next_shot) for r in shots.between_shots(b, s).collect()}
    assert got == {0: (None, 6), 1: (5, 6)}


def test_half_steps_go_to_even(spark):
    row = spark.range(1).select(*[metrics.half_step(__import__("pyspark").sql.functions.lit(x)).alias(str(i)) for i, x in enumerate((3.25, 3.75, 3.3))]).first()
    assert tuple(row) == (3.0, 4.0, 3.5)


def test_union_law_counts_are_sums(spark):
    get = lambda n: __import__("rallyspark.sources.adapters", fromlist=["fixture"]).fixture(spark, SF, n)
    off = collections_.member_offsets(get("fx_shots"), get("fx_rallies"))
    union = collections_.union_streams(get("fx_shots"), off)
    assert union.count() == get("fx_shots").count()
    assert union.groupBy("collection_id", "shot_id").count().filter("count > 1").isEmpty()


def test_segment_rallies_starts_at_serves(spark):
    s = spark.createDataFrame([(1, i, i * 10, v) for i, v in enumerate([False, True, False, True])], "clip_id long, shot_id long, frame long, is_serve boolean")
    assert [(r.shot_id, r.rally_id) for r in rallies.segment_rallies(s).orderBy("shot_id").collect()] == [(1, 0), (2, 0), (3, 1)]


@pytest.mark.parametrize("name", ["m5_shot_mix", "b7_known_runs", "n7_between_shots", "r5_rally_rows", "p1_smooth_and_project", "q4_overall_rating"])
def test_queries_match_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("orders", "lineitem", "events", "customer"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.execute(registry.oracle_sql()[name]).df(), registry.queries()[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns) and len(want) == len(got)
    numbers = [c for c in want.columns if pd.api.types.is_numeric_dtype(want[c])]
    for c in numbers:
        assert want[c].sum() == pytest.approx(got[c].astype(float).sum(), rel=1e-9), c


def test_dedup_serves_and_repeats_match_plain_loops(spark):
    rng = random.Random(8)
    rows = [(c, i, f, rng.randrange(3), rng.random() < 0.3) for c in range(3) for i, f in enumerate(sorted(rng.sample(range(3000), 150)))]
    shots_ = spark.createDataFrame(rows, "clip_id long, shot_id long, frame long, track_id long, is_serve boolean")
    expect = set()
    for c in range(3):
        kept = []
        for r in (r for r in rows if r[0] == c):
            if kept and kept[-1][3] == r[3] and r[2] - kept[-1][2] < 30:
                kept[-1] = kept[-1] if kept[-1][4] else r
            else:
                kept.append(r)
        expect |= {r[:2] for r in kept}
    assert {(r.clip_id, r.shot_id) for r in helpers.same_track_repeats(shots_, 30).collect()} == expect
    serves = [(0, 0, 0, 5, 0), (0, 1, 20, 9, 0), (0, 2, 40, 9, 0), (0, 3, 60, 1, 3), (0, 4, 300, 2, 3), (0, 5, 310, 2, 3)]
    df = spark.createDataFrame(serves, "clip_id long, shot_id long, frame long, run_length long, impulses long")
    df = df.withColumnRenamed("impulses", "upto").selectExpr("*", "upto as before")
    assert {r.shot_id for r in helpers.dedup_serves(df, 50).collect()} == {1, 3, 4}


def test_body_measures_of_hidden_and_flat_bodies(spark):
    from pyspark.sql import functions as F

    from rallyspark.operators import poses
    names = [s + p + c for s in "lr" for p in "shkaw" for c in "xyv"]
    straight = {n: {"s": 0.0, "h": 10.0, "k": 20.0, "a": 30.0, "w": 5.0}[n[1]] if n[2] == "y" else (0.0 if n[0] == "l" else 4.0) if n[2] == "x" else 0.9 for n in names}
    hidden = straight | {n: 0.1 for n in names if n[2] == "v"}
    flat = straight | {"rsx": 0.0}
    df = spark.createDataFrame([tuple(r[n] for n in names) for r in (straight, hidden, flat)], ", ".join(f"{n} double" for n in names))
    side = lambda hand: poses.stroke_side(F.lit(5.0), F.lit(hand).cast("string"), F.lit(False))
    got = df.select(poses.knee_angle().alias("knee"), poses.contact_height(F.lit(12.0)).alias("height"), side("right").alias("r"), side("left").alias("l"), side(None).alias("none")).collect()
    assert (got[0].knee, got[0].height, got[0].r.side, got[0].l.side, got[0].none.side) == (180.0, "low", "forehand", "backhand", "unknown")
    assert (got[1].knee, got[1].height, got[1].r.side, got[1].r.confidence) == (None, "mid", "unknown", 0.0)
    assert (got[2].r.side, got[2].r.confidence) == ("unknown", 0.0)


def test_image_of_undoes_project(spark):
    from pyspark.sql import functions as F

    from rallyspark.functions import geometry as geo
    h = {"h00": 0.0125, "h01": 0.001, "h02": -2.0, "h10": 0.0005, "h11": 0.0625, "h12": -4.0, "h20": 0.00001, "h21": 0.0005, "h22": 1.0}
    df = spark.createDataFrame([(700.0, 300.0, *h.values())], "px double, py double, " + ", ".join(f"{k} double" for k in h))
    x, y = geo.image_of(*geo.project(F.col("px"), F.col("py")))
    got = df.select(x.alias("x"), y.alias("y")).first()
    assert abs(got.x - 700) < 1e-6 and abs(got.y - 300) < 1e-6


def test_dead_runs_between_shots_far_apart(spark):
    """Shots 10^9 frames apart, two on one frame, and dead frames on, before and after them."""
    hits = [(1, 0, 10), (1, 1, 20), (1, 2, 20), (1, 3, 10**9), (2, 0, 5)]
    got = rallies.longest_dead_run(spark.createDataFrame(hits, "clip_id long, shot_id long, frame long"), spark.createDataFrame([(1, f, False, False) for f in (3, 10, 11, 12, 14, 20, 22, 23, 24, 40)], "clip_id long, frame long, visible boolean, interpolated boolean"))
    assert sorted(map(tuple, got.collect())) == [(1, 0, 2), (1, 2, 3)]


def test_flights_and_bounces_of_shots_far_apart(spark):
    """The ball after and between shots 10^9 frames apart, two of them on one frame: a flight ends 90 frames on, the first of the two has none."""
    hits = spark.createDataFrame([(1, 0, 10), (1, 1, 40), (1, 2, 40), (1, 3, 10**9), (2, 0, 5)], "clip_id long, shot_id long, frame long")
    frames = [9, 10, 15, 18, 20, 22, 25, 30, 40, 130, 131, *range(200, 211)]
    seen = spark.createDataFrame([(1, f, True, False, 0.0, 100.0 - abs(f - 20) if f < 40 else 100.0 - 5 * abs(f - 205)) for f in frames], "clip_id long, frame long, visible boolean, interpolated boolean, pixel_x double, pixel_y double")
    flights = trajectory.flight_points(hits, seen).collect()
    assert sorted((r.shot_id, r.frame) for r in flights) == [(0, f) for f in (10, 15, 18, 20, 22, 25, 30)] + [(2, 40), (2, 130)]
    assert sorted((r.shot_id, r.bounced) for r in trajectory.bounced_between(hits, seen).collect()) == [(1, False), (3, True)]


def test_candidates_near_shots_by_a_column(spark):
    """The nearest shot may lie before or after, beyond the last candidate, or be none."""
    hits = spark.createDataFrame([(1, 0, 100), (1, 1, 100), (1, 2, 205), (1, 3, 10**9)], "clip_id long, shot_id long, frame long")
    at = spark.createDataFrame([(c, f, 0.5, near) for c, near in ((1, 10), (2, 10)) for f in (89, 90, 100, 110, 111, 194, 195)], "clip_id long, frame long, score double, near long")
    kept = lambda within: sorted((r.clip_id, r.frame) for r in shots.exclude_near(at, hits, within).collect())
    assert kept("near") == kept(10) == [(1, 89), (1, 111), (1, 194)] + [(2, f) for f in (89, 90, 100, 110, 111, 194, 195)]
