"""Evidence behind ratings and plans, on a hand-made player."""

import pytest
from pyspark.sql import functions as F

from rallyspark.operators import coaching as C

SHOTS = "clip_id long, shot_id long, track_id long, seq int, is_serve boolean, is_volley boolean, shot_type string, stroke_side string, contact_zone string, front double, confidence double"


def proofs(spark):
    shots = [(1, i, 1, 3, False, False, "drop" if i % 4 else "drive", "forehand", "baseline", 0.5 if i % 2 else -0.5, 0.8) for i in range(8)]
    shots += [(1, 8, 1, 3, False, True, "drop", None, "kitchen", None, 0.4), (1, 9, 1, 3, True, False, "drive", None, "baseline", None, 0.4), (1, 10, 5, 3, False, False, "drop", "backhand", "transition", None, 0.2), (1, 11, 9, 1, False, True, "dink", None, None, None, 0.9)]
    roles = [(1, 1, "user", 0.5), (1, 2, "partner", 0.9), (1, 9, "noise", 0.9)]
    players = [(1, 1, f, f % 4 == 0) for f in range(40)] + [(1, 2, f, False) for f in range(20, 60)]
    return C.evidence(spark.createDataFrame(shots, SHOTS), spark.createDataFrame(roles, "clip_id long, track_id long, role string, role_confidence double"),
                      spark.createDataFrame(players, "clip_id long, track_id long, frame long, transient boolean"), spark.createDataFrame([(1, k) for k in range(8)], "clip_id long, rally_id long"))


def test_evidence_is_that_of_each_metric(spark):
    rows = proofs(spark).collect()
    assert [r.role for r in rows] == ["user"]
    r = rows[0]
    assert (r.thirds, r.drop_rate, r.dinks, r.volleys, r.forehands, r.backhands, r.forehand_ahead, r.backhand_ahead) == (8, 0.75, 0, 1, 8, 0, 0.5, None)
    assert r.type_e.confidence == pytest.approx(0.72 * 10 / 18) and r.type_e.limited_by == "sample_size"
    assert r.side_e.confidence == pytest.approx(0.8 * 0.5) and r.volley_e.confidence == pytest.approx(0.4 / 9)
    assert r.third_e.confidence == pytest.approx((8 * 0.8 + 0.2) / 9 * 9 / 17)  # the clip's, whoever hit it
    assert r.serve_e.confidence == pytest.approx(0.4 / 9 * 0.5) and r.length_e.confidence == 0.5
    assert r.position_e.confidence == pytest.approx(0.75 * 40 / 48) and r.position_e.limited_by == "measurement"
    assert r.team_e.confidence == pytest.approx(0.75 * 20 / 28) and r.team_e.limited_by == "sample_size"


def drivers(spark, **changed):
    row = {"shots": 10, "dink_share": 0.0, "volley_rate": 0.1, "serves": 1, "thirds": 99, "drop_rate": 0.0, "dink_knee_n": 0, "dink_knee": None, "forehand_n": 8, "forehand_front": 0.0, "forehand_knee_n": 4, "forehand_knee": 0.25,
           "backhand_n": 0, "backhand_front": None, "backhand_knee_n": 0, "backhand_knee": None, "kitchen": 0.3, "transition": 0.4, "feet_per_minute": 40.0, "both_kitchen": 0.2, "mean_length": 4.0, "faults": 1} | changed
    kinds = {"shots": "long", "serves": "long", "thirds": "long", "faults": "long"}
    schema = "clip_id long, role string, " + ", ".join(f"{k} {kinds.get(k, 'long' if k.endswith('_n') else 'double')}" for k in row)
    return spark.createDataFrame([(1, "user", *row.values())], schema)


def test_categories_and_routes(spark):
    clips = spark.createDataFrame([(1, False)], "clip_id long, synthetic boolean")
    rated = C.categories(drivers(spark), proofs(spark), clips)
    got = {r.category: r for r in rated.collect()}
    assert len(got) == 7 and got["strategy"].confidence == round(0.75 * 20 / 28, 4) and got["strategy"].limited_by == "sample_size" and got["strategy"].coverage == "measured"
    assert got["third_shot"].level == pytest.approx(4.3) and got["third_shot"].events == 8  # its own deep thirds, not those of the drivers
    assert (got["forehand"].confidence, got["backhand"].confidence) == (0.3, 0.05) and got["backhand"].coverage == "not_assessable"
    assert got["volley"].coverage == "partial" and got["serve_return"].coverage == "partial"  # counted, though hardly sure
    plan = {r.category: r for r in C.plan(rated).collect()}
    target = plan["strategy"].target
    assert target == 4.0 and plan["third_shot"].route == "strength" and plan["third_shot"].drills is None
    assert {k for k, r in plan.items() if r.route == "not_assessable"} == {"dink", "volley", "serve_return", "backhand"}
    focus = sorted((r for r in plan.values() if r.route == "focus"), key=lambda r: r["rank"])
    assert [(r.category, r["rank"]) for r in focus] == [("strategy", 1), ("forehand", 2)]
    for r in focus:
        assert r.gap == pytest.approx(target - r.level, abs=1e-3) and r.priority == pytest.approx((target - r.level) * {"strategy": 0.2, "forehand": 0.12}[r.category] * (0.5 + 0.5 * r.confidence), abs=1e-4)
    assert plan["strategy"].finding == "mid" and plan["strategy"].drills == "get_to_line,move_as_unit,transition_resets"  # a fourth has no place
    assert plan["forehand"].drills == "contact_in_front,loaded_stance"


def test_synthetic_clips_and_missing_values(spark):
    clips = spark.createDataFrame([(1, True)], "clip_id long, synthetic boolean")
    rated = C.categories(drivers(spark, kitchen=None, transition=None, both_kitchen=None, dink_share=None), proofs(spark).withColumn("team_e", F.lit(None).cast("struct<confidence:double,limited_by:string>")), clips)
    got = {r.category: r for r in C.plan(rated).collect()}
    assert got["strategy"].route == "not_assessable" and got["strategy"].confidence == 0 and got["strategy"].limited_by == "measurement" and got["strategy"].finding is None
    assert all(r.route != "not_assessable" for k, r in got.items() if k != "strategy")  # provisional, so not left out
    assert got["dink"].level == 3.0 and C.plan(rated.limit(0)).count() == 0


def test_plans_come_back_to_what_was_rated_not_to_the_shots(spark):
    from rallyspark.plans import registry

    plan = registry.queries()["l1_improvement_plan"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "shot_type" not in plan and "transient" not in plan
