"""Shots, contacts and poses meet on their frame once; rows are those of left joins by clip, frame and track."""

import random

import pytest
from pyspark.sql import functions as F

from rallyspark.operators import poses, trajectory

MARKS = [f"{s}{p}{c}" for s in "lr" for p in "ahs" for c in "xyv"]


@pytest.fixture
def tables(spark, tmp_path):
    rnd = random.Random(7)
    shots = [(1, i, 10 * i, rnd.randrange(3), i % 4 == 0, rnd.choice(("near", "far"))) for i in range(60)]
    people = [(1, f, t, part, rnd.uniform(0, 20), rnd.uniform(0, 44), rnd.uniform(0, 90), rnd.uniform(0, 40), rnd.uniform(0, 40)) for _, _, f, *_ in shots for t in range(3) for part in ("hitter", "receiver") for _ in range(rnd.randrange(3))]
    bodies = [(1, f, t, 5.0, *[None if rnd.random() < 0.1 else rnd.uniform(0, 1) if m[2] == "v" else rnd.uniform(0, 90) for m in MARKS]) for _, _, f, *_ in shots for t in range(3) for _ in range(rnd.randrange(3))]
    court = [(1, 60.0, 0.2, 0.0, 0.0, 0.0, 0.5, 0.0, 0.0, 0.0, 1.0, 60.0, 20.0)]
    put = lambda rows, cols: spark.createDataFrame(rows, cols)
    out = {"shots": put(shots, "clip_id long, shot_id long, frame long, track_id long, is_serve boolean, hitter_side string"),
           "contacts": put(people, "clip_id long, frame long, track_id long, part string, court_x_ft double, court_y_ft double, impact_y double, speed_pre double, speed_post double"),
           "poses": put(bodies, "clip_id long, frame long, track_id long, court_y_ft double, " + ", ".join(f"{m} double" for m in MARKS)),
           "court": put(court, "clip_id long, fps double, " + ", ".join(f"h{i}{j} double" for i in range(3) for j in range(3)) + ", near_px_per_ft double, far_px_per_ft double"),
           "landed": put([(1, i, 10 * i + 5, rnd.uniform(0, 20), rnd.uniform(0, 44)) for i in range(0, 60, 3)], "clip_id long, shot_id long, land_frame long, land_x double, land_y double")}
    for name, df in out.items():
        df.write.parquet(f"{tmp_path}/{name}")
    return {name: spark.read.parquet(f"{tmp_path}/{name}") for name in out}


def test_scenes_are_left_joins(tables):
    t, keys = tables, ["clip_id", "frame", "track_id"]
    rows = t["shots"].withColumn("next_track", (F.col("track_id") + 1) % 4)
    feet = poses.front_feet(t["contacts"], t["poses"], t["court"])
    want = (rows.join(t["contacts"].filter("part = 'hitter'").select(*keys, "impact_y", "speed_pre", "speed_post", "court_y_ft"), keys, "left").join(feet, keys, "left").join(t["poses"].drop("court_y_ft"), keys, "left")
            .join(feet.select("clip_id", "frame", F.col("track_id").alias("next_track"), F.col("front_y").alias("receiver_y")), ["clip_id", "frame", "next_track"], "left").withColumn("height", poses.contact_height(F.col("impact_y"))))
    cols = ["shot_id", "track_id", "impact_y", "speed_pre", "speed_post", "court_y_ft", "height", "front_x", "front_y", "receiver_y"]
    got = poses.scenes(rows, t["contacts"], t["poses"], t["court"]).select(*cols)
    assert got.count() == want.count() > 60 and not got.exceptAll(want.select(*cols)).count()


def _scans(df):
    lines = [line for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Relation" in line]
    return [sum(column in line for line in lines) for column in ("impact_y#", "lax#")]


def test_context_reads_contacts_and_poses_once(tables):
    df = trajectory.shot_context(*[tables[n] for n in ("shots", "contacts", "poses", "court", "landed")])
    assert _scans(df) == [1, 1] and df.count() >= 60


def test_typing_reads_contacts_and_poses_once(spark, tables):
    t = tables
    ball = spark.createDataFrame([(1, f, True, False, float(f), float(f % 50)) for f in range(600)], "clip_id long, frame long, visible boolean, interpolated boolean, pixel_x double, pixel_y double")
    bounces = spark.createDataFrame([(1, i, 10 * i + 5, 5.0, 30.0) for i in range(0, 60, 2)], "clip_id long, bounce_id long, frame long, court_x_ft double, court_y_ft double")
    df = trajectory.typed_shots(t["shots"], ball, bounces, t["contacts"], t["poses"], t["court"], trajectory.between_shots(bounces, t["shots"]))
    assert _scans(df) == [1, 1] and {r.shot_id for r in df.collect()} == set(range(60))
