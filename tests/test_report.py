"""Report blocks on a hand-made match."""

import pytest
from pyspark.sql import functions as F

from rallyspark.operators import report

SHOTS = "clip_id long, shot_id long, track_id long, hitter_side string, is_serve boolean, shot_type string, stroke_side string, contact_zone string, contact_front double, knee_angle double, confidence double"
RALLIES = "clip_id long, rally_id long, server long, last_shot long, end_reason string, end_confidence double, n_shots long, shot_ids array<long>"


def match(spark):
    shots = [(1, 0, 1, "near", True, "serve", "forehand", "baseline", 1.0, 165.0, 0.9), (1, 1, 3, "far", False, "drive", "forehand", "baseline", -0.5, 155.0, 0.8), (1, 2, 1, "near", False, "drop", "backhand", "transition", None, 140.0, 0.6),
             (1, 3, 9, "far", False, "dink", "backhand", "kitchen", 0.5, 120.0, 0.5), (1, 4, 2, "near", True, "serve", None, "baseline", None, None, 0.7), (1, 5, 1, "near", False, "lob", "forehand", "baseline", 2.0, 150.0, 0.4)]
    rallies = [(1, 0, 1, 3, "ball-out", 0.8, 4, [0, 1, 2, 3]), (1, 1, 2, 4, "serve-fault", 0.9, 1, [4]), (1, 2, 1, 2, "double-bounce", 0.85, 3, [0, 1, 2]), (1, 3, 1, 1, "ball-not-returned", 0.75, 2, [0, 1]), (1, 4, 8, 5, "net-or-short", 0.8, 3, [0, 1, 5]), (1, 5, None, 99, "unknown", 0.3, 0, [])]
    roles = [(1, 1, "user", 0.9), (1, 2, "partner", 0.5), (1, 3, "opp_a", 0.6), (1, 9, "noise", 0.9), (1, 7, "user", 0.7)]
    return spark.createDataFrame(rallies, RALLIES), spark.createDataFrame(shots, SHOTS), spark.createDataFrame(roles, "clip_id long, track_id long, role string, role_confidence double")


def test_errors_have_owners(spark):
    rallies, shots, roles = match(spark)
    owners = report.error_owners(rallies, shots, roles)
    got = {r.rally_id: (r.owner, r.kind, round(r.confidence, 6), r.server_role) for r in owners.collect()}
    assert got == {0: ("unattributed", "hitter", 0.8, "user"), 1: ("partner", "server", 0.45, "partner"), 2: ("team_far", "receiver", 0.85, "user"), 3: ("team_near", "receiver", 0.75, "user"), 4: ("user", "hitter", 0.64, None), 5: ("unknown", "unknown", 0.3, None)}
    rows = report.errors_by_owner(owners).collect()
    assert sum(r.n for r in rows) == 6 and {r.limited_by for r in rows} == {"sample_size"}
    assert rows[0].attribution_confidence == pytest.approx((0.8 + 0.45 + 0.85 + 0.75 + 0.64 + 0.3) / 6 * 6 / 14)
    players = {r.role: r for r in report.player_report(owners, shots, rallies, roles).collect()}
    assert set(players) == {"user", "partner", "opp_a"} and players["opp_a"].returns.value == 4 and players["user"].shots.value == 3
    assert players["partner"].serve.value.asDict() == {"serves": 1, "faults": 1, "fault_rate": 1.0} and players["partner"].serve.confidence == pytest.approx(0.9 / 9 * 0.5)
    assert players["user"].errors.value == 1 and players["user"].errors.confidence == pytest.approx(0.8 / 9 * 0.8) and players["opp_a"].errors.confidence == 0 and players["opp_a"].serve.value.fault_rate == 0


def test_technique_and_third_shots(spark):
    rallies, shots, roles = match(spark)
    rows = {(r.role, r.what, r.scope): (r.n, r.good, r.share, r.mean) for r in report.technique_report(shots, roles).collect()}
    assert rows[None, "contact", "all"] == (4, 3, 0.75, 0.75) and rows["user", "contact", "forehand"] == (2, 2, 1.0, 1.5) and ("user", "contact", "backhand") not in rows
    # bends: 15 (serve, good), 25 (drive, good), 40 (drop, good), 60 (dink, too deep), 30 (lob: no band)
    assert rows[None, "knees", "all"] == (5, 3, 0.6, 34.0) and rows[None, "knees", "dink"] == (1, 0, 0.0, 60.0) and rows["opp_a", "knees", "drive forehand"] == (1, 1, 1.0, 25.0) and rows["user", "knees", "serve"][:2] == (1, 1)
    third = {r.role: r for r in report.third_shot_report(rallies, shots, roles).collect()}
    assert (third[None].n, third[None].drops, third[None].drives, third[None].drop_rate) == (2, 2, 0, 1.0) and third["user"].n == 2 and set(third) == {None, "user"}
    assert third[None].confidence == pytest.approx(0.6 * 2 / 10)


def test_envelopes(spark):
    row = spark.createDataFrame([(5, 0.5, 8), (0, None, 0), (7, 0.4, 1000)], "v long, c double, n long")
    got = row.select("n", report.sourced(F.col("v"), F.col("c"), F.col("n")).alias("s"), report.sampled(F.col("v"), F.col("n")).alias("p"), report.counted(F.col("v"), F.col("n")).alias("k"), report.known_limit(F.col("v"), F.col("n")).alias("x"),
                     report.positioned(F.col("v"), F.col("c"), F.col("n")).alias("o")).collect()
    by = {r.n: r for r in got}
    assert (by[8].s.confidence, by[8].s.limited_by, by[8].p.confidence, by[8].o.limited_by) == (0.25, "sample_size", 0.5, "measurement")
    assert (by[0].s.confidence, by[0].p.confidence, by[0].k.confidence, by[0].x.confidence, by[0].o.confidence) == (0, 0, 1.0, 0.2, 0)
    assert by[1000].s.limited_by == "measurement" and by[1000].s.confidence == pytest.approx(0.4 * 1000 / 1008)


def test_bounces_against_truth_and_confusions(spark):
    from rallyspark.operators import scoring
    rows = lambda xs: spark.createDataFrame([(1, i, f, inside) for i, (f, inside) in enumerate(xs)], "clip_id long, id long, frame long, is_in boolean")
    r = scoring.bounce_report(rows([(102, True), (108, True), (300, False), (900, None)]), rows([(100, True), (104, False), (305, False), (600, True), (905, None)])).first()
    assert (r.n_truth, r.n_found, r.hits, r.recall, r.precision, r.call_share) == (5, 4, 4, 0.8, 1.0, 0.5)  # the second takes what the first left over
    shots = spark.createDataFrame([(1, 0, 100, "drive", False), (1, 1, 200, "dink", False), (1, 2, 300, "lob", False)], "clip_id long, shot_id long, frame long, shot_type string, is_volley boolean")
    labels = spark.createDataFrame([(1, 0, 101, False, "Drive", None, "n"), (1, 1, 198, False, "drop", None, None), (1, 2, 400, False, "lob", None, None), (1, 3, 300, False, "between pts", None, None), (1, 4, 301, False, None, "a feed", None)],
                                   "clip_id long, label_id long, frame long, by_clock boolean, true_type string, notes string, true_volley string")
    assert {(x.truth, x.said, x.n) for x in scoring.type_confusion(shots, labels).collect()} == {("drive", "drive", 1), ("drop", "dink", 1), ("lob", "not-detected", 1)}
