"""Roles of tracks: made-up matches in which it is known who is who."""

import math
import random

from pyspark.sql import functions as F

from rallyspark.operators import roles

PLAYERS = "clip_id long, track_id long, frame long, court_x_ft double, court_y_ft double, bbox_y1 double, bbox_y2 double, is_user boolean, person string"
PLACES = {"user": (5.0, 8.0), "partner": (15.0, 8.0), "opp_a": (6.0, 36.0), "opp_b": (14.0, 36.0), "third": (22.0, 40.0), "out": (60.0, 90.0)}
LOOKS = {"user": [1.0, 0.1, 0.0, 0.0], "partner": [0.1, 1.0, 0.0, 0.0], "opp_a": [0.0, 0.1, 1.0, 0.0], "opp_b": [0.0, 0.0, 0.2, 1.0], "third": [0.5, 0.5, 0.5, 0.5], "out": [1.0, 1.0, 1.0, 1.0]}


def match(spark, seed, clicked=True, looks=True, people=tuple(PLACES)):
    """Players of one clip whose tracks break up at random; all are seen most of the time."""
    rng, rows, who = random.Random(seed), [], {}
    for i, person in enumerate(people):
        frame, track = 0, 100 * (i + 1)
        while frame < 900:
            end = min(900, frame + rng.randint(60, 260))
            if end - frame >= 40:
                who[track] = person
                x, y = PLACES[person]
                rows += [(1, track, f, x + rng.uniform(-1, 1), y + rng.uniform(-1, 1), 0.0, 300.0 - 3 * i if y < 22 else 150.0 - 3 * i, clicked and person == "user" and track == 100, person) for f in range(frame, end)]
            track, frame = track + 1, end + rng.choice([0, 1, 5])
    court = spark.createDataFrame([(1, 30.0, 50.0, 25.0, "left")], "clip_id long, fps double, near_px_per_ft double, far_px_per_ft double, user_corner string")
    sig = spark.createDataFrame([(1, t, LOOKS[p]) for t, p in who.items()], "clip_id long, track_id long, signature array<double>") if looks else None
    players = spark.createDataFrame(rows, PLAYERS)
    tracks = roles.track_rows(players, court, sig)
    got = roles.assign_roles(tracks, roles.seed_user(tracks, players, court)).collect()
    return who, {r.track_id: r for r in got}, players


def test_everybody_is_found_again(spark):
    for seed, clicked, looks in ((1, True, True), (2, False, True), (3, True, False)):
        who, got, players = match(spark, seed, clicked, looks, ("user", "partner", "opp_a", "opp_b", "out"))
        assert set(got) == set(who)
        for track, person in who.items():
            if person in ("user", "partner", "out"):
                assert got[track].role == {"out": "noise"}.get(person, person), (seed, track, got[track])
        # The opponents' names may be swapped, but not mixed.
        sides = {p: {got[t].role for t, q in who.items() if q == p} for p in ("opp_a", "opp_b")}
        assert len(sides["opp_a"]) == len(sides["opp_b"]) == 1 and sides["opp_a"] | sides["opp_b"] == {"opp_a", "opp_b"}
        assert ("click" if clicked else "opening corner") in {got[t].basis for t, p in who.items() if p == "user"} and all(0 <= r.confidence <= 0.95 for r in got.values())
        cover = roles.role_coverage(players, spark.createDataFrame([(1, t, r.role) for t, r in got.items()], "clip_id long, track_id long, role string")).first()
        assert cover.tracks == len(who) and cover.assigned + cover.noise == len(who) and cover.user_coverage > 0.9


def test_only_two_opponents_at_a_time(spark):
    """Of three people on the far side, two have a role at any time: tracks of one role don't share their frames."""
    who, got, players = match(spark, 7, people=("user", "opp_a", "opp_b", "third"))
    frames = {}
    for r in players.collect():
        frames.setdefault(r.track_id, set()).add(r.frame)
    far = [t for t, p in who.items() if p != "user"]
    assert {got[t].role for t, p in who.items() if p == "user"} == {"user"} and sum(got[t].role == "noise" for t in far) >= 2
    for t in far:
        for u in far:
            if t != u and got[t].role == got[u].role != "noise":
                assert len(frames[t] & frames[u]) <= 0.30 * max(len(frames[t]), len(frames[u]))
        if got[t].basis == "third person":
            assert all(any(got[u].role == role and frames[t] & frames[u] for u in far) for role in ("opp_a", "opp_b"))


def test_near_tracks_without_a_seed_have_no_role(spark):
    rows = [(1, 1, f, 5.0, 8.0, 0.0, 300.0, False, "x") for f in range(90)] + [(1, 2, f, 5.0, 40.0, 0.0, None, False, "x") for f in range(90)] + [(2, 1, 0, None, None, None, None, False, "x")]
    court = spark.createDataFrame([(1, 30.0, 50.0, None, None), (2, 30.0, None, None, "left")], "clip_id long, fps double, near_px_per_ft double, far_px_per_ft double, user_corner string")
    players = spark.createDataFrame(rows, PLAYERS)
    tracks = roles.track_rows(players, court)
    got = {(r.clip_id, r.track_id): r.role for r in roles.assign_roles(tracks, roles.seed_user(tracks, players, court)).collect()}
    assert got == {(1, 1): None, (1, 2): "opp_a", (2, 1): "noise"}


def test_seed_from_the_corner(spark):
    def seed(corner, tracks):
        rows = [(1, t, f, x, 5.0, 0.0, 300.0, False, "x") for t, x, frames in tracks for f in frames]
        court = spark.createDataFrame([(1, 30.0, 50.0, 25.0, corner)], "clip_id long, fps double, near_px_per_ft double, far_px_per_ft double, user_corner string")
        players = spark.createDataFrame(rows, PLAYERS)
        r = roles.seed_user(roles.track_rows(players, court), players, court).first()
        return (r.track_id, round(r.confidence, 6), r.basis)

    both = [(1, 4.0, range(100)), (2, 14.0, range(100))]
    assert seed("left", both) == (1, 0.7, "opening corner") and seed("right", both) == (2, 0.7, "opening corner")
    assert seed("left", [(1, 4.0, range(100)), (2, 5.0, range(100))])[1] == 0.5  # too close to tell
    assert seed("left", both[:1])[1] == 0.7
    # A track that comes after the opening doesn't count while another is there.
    assert seed("left", [(1, 9.0, range(100)), (2, 2.0, range(500, 700))])[0] == 1


def test_clicks_follow_a_track_until_it_is_lost(spark):
    rng = random.Random(4)
    frames = {t: sorted(f for f in range(600) if math.sin(f / (30 + 11 * t)) > -0.5 and rng.random() < 0.9) for t in range(3)}
    players = spark.createDataFrame([(1, t, f) for t, fs in frames.items() for f in fs], "clip_id long, track_id long, frame long")
    clicked = [(1, 0, 10, 0), (1, 1, 200, 2), (1, 2, 330, 0), (1, 3, 331, 1)]
    clicks = spark.createDataFrame(clicked, "clip_id long, click_id long, frame long, track_id long")
    got = roles.click_segments(players, clicks)
    of = {}
    for r in got.collect():
        of.setdefault(r.segment, []).append(r.frame)
        assert r.track_id == clicked[r.segment][3]
    last = max(max(fs) for fs in frames.values()) + 1
    gaps = {r.segment: (r.last_user_frame, r.resumes_at_or_after) for r in roles.click_gaps(got, players, clicks).collect()}
    for k, (_, _, start, track) in enumerate(clicked):
        until = clicked[k + 1][2] if k < 3 else last
        there, have = [f for f in frames[track] if start <= f < until], sorted(of.get(k, []))
        assert have == there[: len(have)]  # the first frames, without a hole
        steps = [b - a for a, b in zip([start] + have, have)]
        assert all(s <= 31 for s in steps)
        seen = have[-1] if have else start
        assert len(have) == len(there) or there[len(have)] - seen > 31
        assert (k in gaps) == (seen + 31 < until) and gaps.get(k, (seen, seen + 31)) == (seen, seen + 31)
    assert got.filter(F.col("frame").isNull()).count() == 0 and gaps


def test_coverage_counts_without_a_copy_of_each_row_per_count(spark):
    players = spark.createDataFrame([(1, 7, 0, True), (1, 7, 1, None), (1, 8, 1, False), (1, 9, 3, False), (1, None, 3, True), (2, 7, 0, False)], "clip_id long, track_id long, frame long, is_user boolean")
    known = spark.createDataFrame([(1, 7, "user"), (1, 8, "noise")], "clip_id long, track_id long, role string")
    got = roles.role_coverage(players, known)
    assert [tuple(r) for r in got.orderBy("clip_id").collect()] == [(1, 3, 1, 1, 0.5, 0.5), (2, 1, 0, 0, 0.0, 0.0)]
    assert "Expand" not in got._jdf.queryExecution().optimizedPlan().toString()
