"""Contexts, speeds and types by tile of frames are those of the joins and windows over whole clips, also across tiles' ends and long pauses; tables that come by tile stay where they are."""

import random

import pytest

from rallyspark.operators import poses, tile_scenes, trajectory
from rallyspark.operators.shots import between_shots
from rallyspark.operators.tiles import TILE
from rallyspark.sources import adapters

MARKS = [f"{s}{p}{c}" for s in "lr" for p in "ahs" for c in "xyv"]
SF = "/root/testdata/sf0.001"


def _tables(spark, seed, copies):
    """Clips whose shots and bounces crowd around the ends of tiles, with empty tiles and tiles of bounces only between; ``copies`` contacts and poses of a track at most."""
    rnd = random.Random(seed)
    near = lambda n: sorted(rnd.sample([t + d for t in (TILE, 2 * TILE, 3 * TILE, 7 * TILE, 8 * TILE) for d in range(-60, 60, 3)], n))
    shots = [(c, i, f, rnd.randrange(3), rnd.random() < 0.3, rnd.choice(("near", "far"))) for c in (1, 2) for i, f in enumerate(near(60))] + [(3, 0, 5, 0, True, "near"), (4, 0, TILE - 1, 1, False, "far"), (4, 1, 9 * TILE, 1, False, "near")]
    frames = [(c, f + rnd.choice((0, 1, 2, 5))) for c in (1, 2) for f in near(70)] + [(1, 5 * TILE + 3), (1, 5 * TILE + 4), (3, 4 * TILE), (4, 5 * TILE), (4, 9 * TILE)]
    bounces = [(c, i, f, rnd.uniform(0, 20), None if rnd.random() < 0.2 else rnd.uniform(0, 44)) for i, (c, f) in enumerate(frames)]
    some = lambda: range(rnd.randrange(copies + 1))
    seen = [(c, f, t) for c, _, f, *_ in shots for t in range(3)]
    people = [(*k, rnd.choice(("hitter", "receiver")), rnd.uniform(0, 20), rnd.choice((None, rnd.uniform(0, 44))), rnd.uniform(0, 90), rnd.uniform(0, 40), rnd.uniform(0, 40)) for k in seen for _ in some()]
    bodies = [(*k, 5.0, *[None if rnd.random() < 0.1 else rnd.uniform(0, 1) if m[2] == "v" else rnd.uniform(0, 90) for m in MARKS]) for k in seen for _ in some()]
    court = [(c, 60.0, 0.2, 0.0, 0.0, 0.0, 0.5, 0.0, 0.0, 0.0, 1.0, 60.0, 20.0) for c in (1, 2, 3, 4)]
    put = spark.createDataFrame
    return {"shots": put(shots, "clip_id long, shot_id int, frame long, track_id long, is_serve boolean, hitter_side string"),
            "bounces": put(bounces, "clip_id long, bounce_id long, frame long, court_x_ft double, court_y_ft double"),
            "contacts": put(people, "clip_id long, frame long, track_id long, part string, court_x_ft double, court_y_ft double, impact_y double, speed_pre double, speed_post double"),
            "poses": put(bodies, "clip_id long, frame long, track_id long, court_y_ft double, " + ", ".join(f"{m} double" for m in MARKS)),
            "court": put(court, "clip_id long, fps double, " + ", ".join(f"h{i}{j} double" for i in range(3) for j in range(3)) + ", near_px_per_ft double, far_px_per_ft double")}


def _same(got, want):
    assert got.dtypes == want.dtypes
    key = lambda r: tuple((v is None, str(v)) for v in r)
    rows = [sorted(map(tuple, df.collect()), key=key) for df in (got, want)]
    assert rows[0] == rows[1]
    return rows[0]


@pytest.mark.parametrize("copies", [1, 2])
def test_contexts_across_tiles_are_those_of_left_joins(spark, copies):
    t = _tables(spark, copies, copies)
    want = trajectory.shot_context(t["shots"], t["contacts"], t["poses"], t["court"], trajectory.landing(t["bounces"], t["shots"]))
    rows = _same(trajectory.context_by_tile(**t), want)
    assert len(rows) >= 123 and len({r[5] for r in rows}) > 2 and any(r[6] is not None for r in rows) and any(r[3] for r in rows)


def test_speeds_across_tiles_go_to_the_next_contact(spark):
    t = _tables(spark, 3, 1)
    feet = poses.front_feet(t["contacts"], t["poses"], t["court"])
    rows = _same(trajectory.speed_by_tile(**t), trajectory.anchored_speed(t["shots"], trajectory.landing(t["bounces"], t["shots"]), feet, t["court"]))
    assert {r[2] for r in rows} == {"bounce", "contact"}


def test_types_across_tiles(spark):
    t = _tables(spark, 4, 1)
    ball = spark.createDataFrame([(c, f, f % 7 > 0, f % 14 == 0, float(f % 90), float(f * 13 % 50)) for c in (1, 2) for f in range(TILE - 150, TILE + 50)], "clip_id long, frame long, visible boolean, interpolated boolean, pixel_x double, pixel_y double")
    want = trajectory.typed_shots(t["shots"], ball, t["bounces"], t["contacts"], t["poses"], t["court"], between_shots(t["bounces"], t["shots"]))
    assert len({r[2] for r in _same(trajectory.typed_by_tile(**t, ball=ball), want)}) > 3


def test_shots_in_reach_bound_the_last_flight(spark):
    t = _tables(spark, 5, 1)
    ball = spark.createDataFrame([(1, f, True, False, float(f % 90), float(f % 50)) for f in range(TILE - 70, TILE + 11)], "clip_id long, frame long, visible boolean, interpolated boolean, pixel_x double, pixel_y double")
    near = trajectory.in_reach(t["shots"], ball)
    frames = sorted(r.frame for r in t["shots"].filter("clip_id = 1").collect())
    assert sorted(r.frame for r in near.collect()) == [f for f in frames if f <= TILE + 10] + [min(f for f in frames if f > TILE + 10)]
    _same(trajectory.arc_height(trajectory.flight_points(near, ball)), trajectory.arc_height(trajectory.flight_points(t["shots"], ball)))
    _same(trajectory.bounced_between(near, ball), trajectory.bounced_between(t["shots"], ball))


@pytest.mark.parametrize("per_bucket", [adapters.BUCKET_ROWS, 700])
def test_tables_by_tile_stay_where_they_are(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(adapters, "BUCKET_ROWS", per_bucket)
    get = adapters.fixtures(spark, SF)
    t = {name: get(f"fx_{name}", tiled=True) for name in ("shots", "contacts", "poses")}
    for name, rows in t.items():
        want = adapters.fixture(spark, SF, f"fx_{name}")
        assert rows.drop("tile_").dtypes == want.dtypes and rows.count() == want.count() and not rows.drop("tile_").exceptAll(want).count()
        assert not rows.filter(f"tile_ <> floor(frame / {TILE})").count()
    events = tile_scenes.events(**t, bounces=get("fx_bounces"), court=get("fx_court"), hits=True, flights=None)
    plan = tile_scenes.standing(tile_scenes.neighbours(events))._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "tile_" in line]
    assert len(moves) == 1 and "SortMergeJoin" not in plan  # the bounces'
    assert len([line for line in plan.splitlines() if "Sort [" in line and "kind_" in line]) == 1
    assert t["shots"].schema["tile_"].metadata["buckets"] == max(4, adapters.fixture(spark, SF, "fx_shots").count() // per_bucket)
