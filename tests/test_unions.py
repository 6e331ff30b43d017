"""Collections of clips and venues on small hand-made tables."""

import pytest

from rallyspark.operators import evaluation, unions


def streams(spark):
    """Clips 3 and 5 of collection 1 (5 comes second), clip 4 alone; clip 5 has no shots but a bounce."""
    members = spark.createDataFrame([(1, 5), (1, 3), (2, 4)], "collection_id long, clip_id long")
    shots = spark.createDataFrame([(3, 0, 10, 7, "drive"), (3, 4, 90, 2, "dink"), (4, 1, 30, 1, "lob")], "clip_id long, shot_id long, frame long, track_id long, shot_type string")
    rallies = spark.createDataFrame([(3, 0, 10, 100, 2, "unknown", [0, 4], 0, 7), (4, 0, 30, 30, 1, "unknown", [1], 1, 1)],
                                    "clip_id long, rally_id long, start_frame long, end_frame long, n_shots long, end_reason string, shot_ids array<long>, serve_shot_id long, server long")
    bounces = spark.createDataFrame([(3, 0, 50, [0, 4]), (5, 2, 40, [None, None]), (4, 0, 40, [1, None])], "clip_id long, bounce_id long, frame long, between array<long>")
    players = spark.createDataFrame([(3, 120, 7, 1.0, 2.0), (5, 0, 0, 1.0, 2.0), (4, 5, 1, 1.0, 2.0)], "clip_id long, frame long, track_id long, court_x_ft double, court_y_ft double")
    roles = spark.createDataFrame([(3, 7, "user", 0.9), (3, 2, "opp_b", 0.5), (5, 0, "opp_a", 0.6), (4, 1, "noise", 0.9)], "clip_id long, track_id long, role string, role_confidence double")
    court = spark.createDataFrame([(3, 10.0, True), (5, 20.0, False), (4, 10.0, True)], "clip_id long, fps double, real boolean")
    return members, shots, rallies, bounces, players, roles, court


def test_ids_frames_and_references_move_together(spark):
    parts = streams(spark)
    members, *tables, court = parts
    offsets = unions.all_offsets(*parts)
    by = {r.clip_id: r for r in offsets.collect()}
    assert (by[3].video_id, by[3].shots_before, by[3].frames_before, by[3].span_sec) == (0, 0, 0, 9.0)
    assert (by[5].video_id, by[5].shots_before, by[5].rallies_before, by[5].bounces_before, by[5].tracks_before, by[5].frames_before, by[5].sec_before, by[5].span_sec) == (1, 5, 1, 1, 8, 121, 9.0, 0.0)
    u = unions.union_all(offsets, *tables, court)
    assert {(r.collection_id, r.shot_id, r.frame, r.video_frame, r.track_id, r.t_sec) for r in u["shots"].collect()} == {(1, 0, 10, 10, 7, 1.0), (1, 4, 90, 90, 2, 9.0), (2, 1, 30, 30, 1, 3.0)}
    assert {(r.collection_id, r.bounce_id, r.frame, tuple(r.between), r.t_sec) for r in u["bounces"].collect()} == {(1, 0, 50, (0, 4), 5.0), (1, 3, 161, (None, None), 11.0), (2, 0, 40, (1, None), 4.0)}
    assert {(r.track_id, r.role) for r in u["roles"].filter("collection_id = 1").collect()} == {(7, "user"), (2, "opp_a"), (8, "opp_a")}
    assert {(r.track_id, r.role) for r in unions.union_all(offsets, *tables, court, pool=False)["roles"].collect()} >= {(2, "opp_b")}
    ok = {r.collection_id: r.asDict() for r in unions.check_references(u).collect()}
    assert ok[1] == {"collection_id": 1, "rallies_refs": 2, "bounces_refs": 2, "rallies_dangling": 0, "bounces_dangling": 0, "shared_frames": 0, "tracks_without_role": 0}
    broken = u | {"shots": u["shots"].filter("shot_id <> 4"), "roles": u["roles"].filter("track_id <> 8"), "bounces": u["bounces"].withColumn("frame", u["bounces"]["video_frame"] * 0)}
    bad = {r.collection_id: r.asDict() for r in unions.check_references(broken).collect()}[1]
    assert (bad["rallies_dangling"], bad["bounces_dangling"], bad["shared_frames"], bad["tracks_without_role"]) == (1, 1, 1, 1)
    rows = {r.clip_id: r for r in unions.provenance(offsets, tables[0], tables[1], tables[2], court).collect()}
    assert (rows[5].n_shots, rows[5].n_bounces, rows[5].ball_source, rows[3].n_rallies, rows[3].ball_source) == (0, 1, "synthetic", 1, "real")
    gated = spark.createDataFrame([(3, "speed"), (5, "net"), (5, "speed")], "clip_id long, metric string")
    worst = {r.collection_id: r for r in unions.reliability(members, court, gated).collect()}
    assert worst[1].synthetic and worst[1].gated == ["net", "speed"] and not worst[2].synthetic and worst[2].gated == []


def test_venues_are_judged_and_compared(spark):
    signals = spark.createDataFrame([(1, 0.9, 0.6, 0.9, 50), (2, 0.4, 0.6, 0.9, 50), (3, 0.9, 0.1, 0.9, 50), (4, 0.9, 0.6, 0.1, 20), (5, 0.9, 0.6, 0.1, 19), (6, None, 0.6, None, 0), (7, 0.9, 0.6, None, 0)],
                                    "clip_id long, p90_conf double, det_rate double, moving_share double, n_steps long")
    known = spark.createDataFrame([(10, 0.8, 0.6, 0.95), (11, 0.3, 0.1, 0.05), (12, 1.0, 0.6, 0.9), (13, None, 0.2, 0.1)], "clip_id long, p90_conf double, det_rate double, recall double")
    got = {r.clip_id: r for r in evaluation.venue_verdicts(signals, known).collect()}
    assert {i: r.reason for i, r in got.items()} == {1: "ok", 2: "faint", 3: "rare", 4: "parked", 5: "ok", 6: "signals missing", 7: "ok"}
    assert {r.verdict for i, r in got.items() if i in (2, 3, 4)} == {"not_supported"} and got[6].verdict == "unknown" and got[6].nearest is None
    assert got[1].nearest == 10 and got[2].nearest == 10 and got[2].nearest_recall == 0.95
    with pytest.raises(ValueError):
        evaluation.venue_verdicts(signals, known, most=3)


def test_label_samples_agree_between_reruns(spark):
    rows = [(c, f, f % 5 != 0, float(f) if f % 7 else None, 1.0) for c in range(3) for f in range(300)]
    labels = spark.createDataFrame(rows, "clip_id long, frame long, ball_visible boolean, label_x double, label_y double")
    take = lambda df, seed, n=50: {(r.clip_id, r.frame) for r in evaluation.sample_labels(df, n, seed).collect()}
    one = take(labels, 1)
    assert one == take(labels.repartition(7), 1) and one != take(labels, 2) and take(labels, 1, 20) < one
    assert all(sum(c == k for c, _ in one) == 50 for k in range(3)) and all(f % 5 and f % 7 for _, f in one)
    assert len(take(labels, 1, 10_000)) == 3 * sum(1 for f in range(300) if f % 5 and f % 7)


def test_offsets_and_shots_are_derived_once(spark):
    from rallyspark.plans import registry

    got = registry.queries()["a5_check_references"](spark, "/root/testdata/sf0.001")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "lineitem" not in " ".join(got.inputFiles()) and "AS span_sec" not in plan and "AS end_frame" not in plan
