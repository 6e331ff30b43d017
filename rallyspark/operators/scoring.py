"""Shots, serves, types and rallies against what an operator saw; rally ends; counts side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import project
from .helpers import first_unused, match_one_to_one, merge_ends
from .poses import point
from .tiles import tiled


def _matched(review: DataFrame, kind: str, shots: DataFrame, tolerance: int) -> DataFrame:
    """(clip_id, truth_id, shot_id) of the review rows of one kind, closest first, each side used once."""
    truth = review.filter(F.col("kind") == kind).select("clip_id", F.col("frame").cast("long").alias("frame"), F.col("truth_id").cast("long").alias("truth_id"))
    got = shots.select("clip_id", F.col("frame").cast("long").alias("frame"), F.col("shot_id").cast("long").alias("got_id"))
    return match_one_to_one(truth, got, tolerance).select("clip_id", "truth_id", F.col("got_id").alias("shot_id"))


def _nearest_note(matched: DataFrame, shots: DataFrame, review: DataFrame, kind: str, tolerance: int, what: str) -> DataFrame:
    """``what`` of the review row of a kind that is nearest to each matched shot (ties: the smaller id)."""
    notes = review.filter(F.col("kind") == kind).select("clip_id", F.col("frame").alias("at"), "truth_id", what, F.floor(F.col("frame") / tolerance).alias("bucket"))
    rows = matched.select("clip_id", "shot_id").join(shots.select("clip_id", "shot_id", "frame", "is_user"), ["clip_id", "shot_id"])
    rows = rows.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("frame") / tolerance) - 1, F.floor(F.col("frame") / tolerance) + 1)))
    best = F.min(F.struct(F.abs(F.col("at") - F.col("frame")).alias("d"), "truth_id", what))
    return rows.join(notes, ["clip_id", "bucket"]).groupBy("clip_id", "shot_id", "is_user").agg(best.alias("b")).select("clip_id", "shot_id", "is_user", F.col("b")[what].alias(what))


def score_shots(shots: DataFrame, review: DataFrame, tolerance: int = 60) -> DataFrame:
    """Per clip: false positives still there and gone, missed shots found, wrong players left, real shots kept, precision.

    ``review(clip_id, truth_id, kind, frame, cause, said)``, kind one of false_positive, missed, wrong_player."""
    found = {k: _matched(review, k, shots, tolerance) for k in ("false_positive", "missed", "wrong_player")}
    wrong = _nearest_note(found["wrong_player"], shots, review, "wrong_player", tolerance, "said").filter(F.col("is_user") == (F.col("said") == "user"))
    count = lambda df, name: df.groupBy("clip_id").agg(F.count("*").alias(name))
    labelled = review.groupBy("clip_id").pivot("kind", ["false_positive", "missed", "wrong_player"]).agg(F.count("truth_id"))
    out = count(shots, "n_detected").join(labelled, "clip_id", "left")
    for df, name in ((found["false_positive"], "false_positives"), (found["missed"], "missed_found"), (wrong, "wrong_left")):
        out = out.join(count(df, name), "clip_id", "left")
    out = out.na.fill(0)
    real = F.col("n_detected") - F.col("false_positives")
    return out.select("clip_id", "n_detected", "false_positives", (F.col("false_positive") - F.col("false_positives")).alias("false_gone"), "missed_found", (F.col("missed") - F.col("missed_found")).alias("still_missed"),
                      "wrong_left", F.col("wrong_player").alias("wrong_labelled"), real.alias("real_kept"), F.try_divide(real, F.col("n_detected")).alias("precision"))


def false_causes(shots: DataFrame, review: DataFrame, tolerance: int = 60) -> DataFrame:
    """How many false positives of each cause are still detected."""
    matched = _matched(review, "false_positive", shots, tolerance)
    return _nearest_note(matched, shots, review, "false_positive", tolerance, "cause").groupBy("clip_id", "cause").agg(F.count("*").alias("still_there"))


def score_serves(starts: DataFrame, truth: DataFrame, strikes: DataFrame, fps: float = 60.0, tolerance: float = 3.0) -> DataFrame:
    """Recall and precision of serves (rally starts) within ``tolerance`` seconds, and their distance from marked strikes:
    the upper median, the worst, the share within half a second. Tables are (clip_id, frame, id)."""
    long = lambda df, name: df.select("clip_id", F.col("frame").cast("long").alias("frame"), F.col("id").cast("long").alias(name))
    frames = int(tolerance * fps)
    hits = match_one_to_one(long(truth, "truth_id"), long(starts, "got_id"), frames).groupBy("clip_id").agg(F.count("*").alias("hits"))
    timed = match_one_to_one(long(strikes, "truth_id"), long(starts, "got_id"), frames).groupBy("clip_id").agg(F.sort_array(F.collect_list(F.col("distance") / fps)).alias("e"))
    n = truth.groupBy("clip_id").agg(F.count("*").alias("n_truth")).join(starts.groupBy("clip_id").agg(F.count("*").alias("n_found")), "clip_id", "full").na.fill(0)
    rows = n.join(hits, "clip_id", "left").na.fill(0).join(timed, "clip_id", "left")
    return rows.select("clip_id", "n_truth", "n_found", "hits", F.try_divide("hits", "n_truth").alias("recall"), F.try_divide("hits", "n_found").alias("precision"), F.get("e", F.floor(F.size("e") / 2).cast("int")).alias("median_error"),
                       F.array_max("e").alias("worst_error"), (F.size(F.filter("e", lambda x: x <= 0.5)) / F.size("e")).alias("close_share"))


COUNTS = {"shots": "true", "serves": "is_serve", "user_shots": "is_user", "volleys": "is_volley", "dinks": "shot_type = 'dink'", "user_drive": "is_user and shot_type = 'drive'", "user_serve": "is_user and shot_type = 'serve'",
          "user_dink": "is_user and shot_type = 'dink'", "user_drop": "is_user and shot_type = 'drop'", "user_volley": "is_user and is_volley", "user_forehand": "is_user and stroke_side = 'forehand'", "user_backhand": "is_user and stroke_side = 'backhand'"}


def clip_counts(shots: DataFrame, bounces: DataFrame, rallies: DataFrame) -> DataFrame:
    """(clip_id, metric, value): the counts that an operator can make too."""
    of_shots = shots.groupBy("clip_id").agg(*[F.count_if(F.expr(test)).alias(k) for k, test in COUNTS.items()])
    wide = of_shots.join(bounces.groupBy("clip_id").agg(F.count("*").alias("bounces")), "clip_id", "left").join(rallies.groupBy("clip_id").agg(F.count("*").alias("rallies")), "clip_id", "left")
    return wide.unpivot("clip_id", [*COUNTS, "bounces", "rallies"], "metric", "value")


def acceptance(counts: DataFrame, truth: DataFrame, snapshot: DataFrame) -> DataFrame:
    """Each count against truth and against a snapshot of earlier counts: error, share, and whether it came closer.
    All three are (clip_id, metric, value)."""
    rows = (counts.withColumnRenamed("value", "got").join(truth.withColumnRenamed("value", "truth"), ["clip_id", "metric"], "left").join(snapshot.withColumnRenamed("value", "was"), ["clip_id", "metric"], "left"))
    now, then = F.abs(F.col("got") - F.col("truth")), F.abs(F.col("was") - F.col("truth"))
    move = (F.when(F.col("was").isNull() | F.col("got").isNull(), None).when(F.col("was") == F.col("got"), "unchanged").when(F.col("truth").isNull(), "moved").when(now < then, "better").when(now > then, "worse").otherwise("same error"))
    return rows.select("clip_id", "metric", "got", "truth", (F.col("got") - F.col("truth")).alias("error"), F.try_divide(now, F.col("truth")).alias("error_share"), move.alias("move"))


def acceptance_summary(counts: DataFrame, truth: DataFrame) -> DataFrame:
    """Per clip: the mean absolute error over the metrics with truth, and shots less volleys and bounces (0: each shot is
    volleyed or bounces once)."""
    rows = counts.join(truth.withColumnRenamed("value", "truth"), ["clip_id", "metric"], "left")
    of = lambda m: F.sum(F.when(F.col("metric") == m, F.col("value")))
    return rows.groupBy("clip_id").agg(F.count("truth").alias("scored"), F.round(F.avg(F.try_divide(F.abs(F.col("value") - F.col("truth")), F.col("truth"))), 9).alias("mean_error"), (of("shots") - of("volleys") - of("bounces")).alias("identity_gap"))


#: What an operator writes for a detection that is no shot.
NOT_A_SHOT = ("between pts", "between shots", "between points", "between point", "between", "not a shot", "none")


def typed_labels(shots: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels with the nearest shot within 3 frames (4 if they only had a clock): (clip_id, label_id, is_shot, truth, said, volley_right).

    ``labels(clip_id, label_id, frame, by_clock, true_type, notes, true_volley)``; ties go to the earlier shot. A type that
    names no shot, or a note without a type, is not a shot; a row without both is no label."""
    kind = F.lower(F.trim(F.coalesce("true_type", F.lit(""))))
    rows = labels.withColumn("truth", kind).withColumn("is_shot", F.when(kind.isin(*NOT_A_SHOT) | ((kind == "") & (F.trim(F.coalesce("notes", F.lit(""))) != "")), False).when(kind != "", True)).filter("is_shot is not null")
    # Labels and shots meet in the label's tile of frames; shots near a tile's end are in both.
    frame = F.col("frame").cast("long")
    asked = rows.select("clip_id", frame.alias("frame"), F.when(F.col("by_clock"), 4).otherwise(3).alias("reach"), F.struct("label_id", "is_shot", "truth", "true_volley").alias("label"))
    hits = shots.select("clip_id", frame.alias("frame"), "shot_id", "shot_type", "is_volley").filter("frame is not null").withColumn("hit_", F.lit(True))
    both = tiled(asked, F.col("frame"), F.col("frame")).unionByName(tiled(hits, F.col("frame") - 4, F.col("frame") + 4), allowMissingColumns=True)
    side = lambda order: Window.partitionBy("clip_id", "tile_").orderBy(order).rangeBetween(Window.unboundedPreceding, 0)
    shot = lambda *by: F.when(F.col("hit_"), F.struct(*by, "shot_type", "is_volley"))
    before = F.max(shot("frame", (-F.col("shot_id")).alias("place"))).over(side(F.asc("frame")))  # of shots on a frame the smallest id
    after = F.min(shot("frame", F.col("shot_id").alias("place"))).over(side(F.desc("frame")))
    met = both.withColumns({"b_": before, "a_": after}).filter("label is not null")
    found = lambda s: F.when(F.abs(F.col(f"{s}.frame") - F.col("frame")) <= F.col("reach"), F.struct(F.abs(F.col(f"{s}.frame") - F.col("frame")).alias("d"), f"{s}.frame", f"{s}.shot_type", f"{s}.is_volley"))
    hit = met.select("clip_id", "label.*", F.array_min(F.array_compact(F.array(found("b_"), found("a_")))).alias("s"))
    right = F.when(F.col("is_shot") & F.lower("true_volley").isin("y", "n"), (F.lower("true_volley") == "y") == F.coalesce(F.col("s.is_volley"), F.lit(False)))
    return hit.select("clip_id", "label_id", "is_shot", "truth", F.coalesce(F.lower("s.shot_type"), F.lit("not-detected")).alias("said"), right.alias("volley_right"))


def type_report(shots: DataFrame, labels: DataFrame) -> DataFrame:
    """Per clip and type: labels, precision, recall and F1 of shot types over the labels that are shots."""
    rows = typed_labels(shots, labels).filter("is_shot")
    sides = rows.select("clip_id", F.explode(F.array(F.struct(F.col("truth").alias("type"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col("truth") == F.col("said")).cast("int").alias("ok")),
                                                     F.struct(F.col("said").alias("type"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("ok")))).alias("x")).select("clip_id", "x.*")
    sums = sides.groupBy("clip_id", "type").agg(F.sum("t").alias("n"), F.sum("p").alias("n_said"), F.sum("ok").alias("right"))
    p, r = F.coalesce(F.try_divide("right", "n_said"), F.lit(0.0)), F.coalesce(F.try_divide("right", "n"), F.lit(0.0))
    return sums.select("clip_id", "type", "n", "n_said", "right", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def type_confusion(shots: DataFrame, labels: DataFrame) -> DataFrame:
    """How often each labelled type was said to be what, per clip: clip_id, truth, said, n. Labels that are no shots are counted by
    type_accuracy(), so that false detections don't hide among wrong types."""
    return typed_labels(shots, labels).filter("is_shot").groupBy("clip_id", "truth", "said").agg(F.count("*").alias("n"))


def type_accuracy(shots: DataFrame, labels: DataFrame) -> DataFrame:
    """Per clip: labelled shots and non-shots, accuracy of types and of volley flags, non-shots that were detected."""
    rows = typed_labels(shots, labels)
    return rows.groupBy("clip_id").agg(F.count_if("is_shot").alias("real_shots"), F.count_if(F.expr("not is_shot")).alias("not_shots"), F.count_if(~F.col("is_shot") & (F.col("said") != "not-detected")).alias("not_shots_detected"),
                                       F.avg(F.when(F.col("is_shot"), (F.col("truth") == F.col("said")).cast("int"))).alias("type_accuracy"), F.avg(F.col("volley_right").cast("int")).alias("volley_accuracy"))


def rally_report(rallies: DataFrame, truth: DataFrame, within: int = 6) -> DataFrame:
    """Per clip: truth rallies whose start is found (in truth order, the first unused detected one within reach) and the share
    of those with the same end reason. Both are (clip_id, id, frame, reason)."""
    long = lambda df, name: df.select("clip_id", F.col("frame").cast("long").alias("frame"), F.col("id").cast("long").alias(name))
    pairs = first_unused(long(truth, "truth_id"), long(rallies, "got_id"), within)
    same = (pairs.join(truth.select("clip_id", F.col("id").alias("truth_id"), F.col("reason").alias("a")), ["clip_id", "truth_id"]).join(rallies.select("clip_id", F.col("id").alias("got_id"), F.col("reason").alias("b")), ["clip_id", "got_id"]))
    got = same.groupBy("clip_id").agg(F.count("*").alias("found"), F.count_if(F.col("a").eqNullSafe(F.col("b"))).alias("same_reason"))
    return truth.groupBy("clip_id").agg(F.count("*").alias("n_truth")).join(got, "clip_id", "left").na.fill(0).select(
        "clip_id", "n_truth", "found", (F.col("found") / F.col("n_truth")).alias("recovery"), F.try_divide("same_reason", "found").alias("reason_accuracy"))


def bounce_report(bounces: DataFrame, truth: DataFrame, within: int = 6) -> DataFrame:
    """Per clip: true bounces that are found (in truth order, the first unused detected one within reach), recall and precision,
    and the share of those with the same call. Both are (clip_id, id, frame, is_in); an unknown call agrees with none."""
    pairs = first_unused(truth.select("clip_id", "frame", F.col("id").alias("truth_id")), bounces.select("clip_id", "frame", F.col("id").alias("got_id")), within)
    called = pairs.join(truth.select("clip_id", F.col("id").alias("truth_id"), F.col("is_in").alias("true_in")), ["clip_id", "truth_id"]).join(bounces.select("clip_id", F.col("id").alias("got_id"), F.col("is_in").alias("got_in")), ["clip_id", "got_id"])
    hits = called.groupBy("clip_id").agg(F.count("*").alias("hits"), F.count_if(F.col("true_in") == F.col("got_in")).alias("same_call"))
    n = truth.groupBy("clip_id").agg(F.count("*").alias("n_truth")).join(bounces.groupBy("clip_id").agg(F.count("*").alias("n_found")), "clip_id", "full").join(hits, "clip_id", "left").na.fill(0)
    return n.select("clip_id", "n_truth", "n_found", "hits", F.try_divide("hits", "n_truth").alias("recall"), F.try_divide("hits", "n_found").alias("precision"), F.try_divide("same_call", "hits").alias("call_share"))


def rally_ends(shots: DataFrame, ball: DataFrame, bounces: DataFrame, fps: float = 60.0) -> DataFrame:
    """Ends of rallies: (clip_id, frame, reason, by_shot, hitter_side).

    For each shot, in the six seconds after it: the net, where the ball first is dead for half a second (65 % of samples at
    most 1 ft high and 8 ft from the net, within 6 ft; all within the six seconds) before the next shot and half a second; else
    out, if the next bounce lies over 1 ft outside, by the nearest sample; else not returned, if no shot follows that bounce for
    2 seconds. Ends that aren't at the net need
    shots from both sides since the last serve; of ends less than 2 seconds apart the first stays. ``ball(clip_id, frame,
    x, y, z)`` in feet, a row per reconstructed frame; ``bounces(clip_id, frame)``."""
    look, half, pause = int(6 * fps), int(0.5 * fps), int(2 * fps)
    ahead = Window.partitionBy("clip_id").orderBy("frame").rangeBetween(0, half)
    low = ((F.col("z") <= 1) & (F.abs(F.col("y") - 22) <= 8)).cast("int")
    travel = F.greatest(F.max("x").over(ahead) - F.min("x").over(ahead), F.max("y").over(ahead) - F.min("y").over(ahead))
    dead = (F.avg(low).over(ahead) >= 0.65) & (travel <= 6)
    order = Window.partitionBy("clip_id").orderBy("frame", "shot_id")
    back = Window.partitionBy("clip_id").orderBy(F.desc("frame")).rangeBetween(Window.unboundedPreceding, -1)
    # Samples, bounces and the ends of looks in one order of frames: bounces take the place of the nearest sample (of two the
    # earlier one), looks the frame of their last sample.
    marks = bounces.select("clip_id", F.col("frame").cast("long").alias("frame"), F.lit("bounce").alias("what")).distinct().unionByName(
        shots.select("clip_id", (F.col("frame") + look).cast("long").alias("frame"), F.lit("look").alias("what")).distinct())
    sample = F.when(F.col("what") == "sample", F.struct("frame", "x", "y"))
    laid = ball.select("clip_id", F.col("frame").cast("long").alias("frame"), F.lit("sample").alias("what"), "x", "y").unionByName(marks, allowMissingColumns=True)
    by = Window.partitionBy("clip_id")
    laid = laid.withColumns({"p": F.max(sample).over(by.orderBy("frame").rangeBetween(Window.unboundedPreceding, 0)), "n": F.min(sample).over(by.orderBy(F.desc("frame")).rangeBetween(Window.unboundedPreceding, 0))}).filter("what <> 'sample'")
    later = F.col("p").isNull() | F.coalesce(F.col("n.frame") - F.col("frame") < F.col("frame") - F.col("p.frame"), F.lit(False))
    near = laid.filter("what = 'bounce'").withColumn("s", F.when(later, F.col("n")).otherwise(F.col("p"))).filter("s is not null")
    ends_of_looks = laid.filter("what = 'look'").select("clip_id", (F.col("frame") - look).alias("frame"), F.col("p.frame").alias("last_sample"))
    # Shots, dead balls and bounces in one order of frames: each shot takes the first of either after it.
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    hits = shots.select("clip_id", F.col("frame").cast("long").alias("frame"), F.lit("shot").alias("what"), F.col("shot_id").cast("long").alias("shot_id"), "hitter_side", "is_serve", none("double", "x"), none("double", "y"), F.lead("frame").over(order).cast("long").alias("next_shot"))
    hits = hits.join(ends_of_looks, ["clip_id", "frame"])
    rest = [F.lit(None).cast("long").alias("shot_id"), none("string", "hitter_side"), none("boolean", "is_serve")]
    deads = ball.withColumn("dead", dead).filter("dead").select("clip_id", F.col("frame").cast("long").alias("frame"), F.lit("dead").alias("what"), *rest, "x", "y", none("long", "next_shot"), none("long", "last_sample"))
    lands = near.select("clip_id", "frame", F.lit("bounce").alias("what"), *rest, "s.x", "s.y", none("long", "next_shot"), none("long", "last_sample"))
    events = hits.unionByName(deads).unionByName(lands)
    after = lambda what: F.min(F.when(F.col("what") == what, F.struct("frame", "x", "y"))).over(back)
    rows = events.withColumn("dead", after("dead")).withColumn("bounce", after("bounce")).filter("what = 'shot'")
    net = F.coalesce((F.col("dead.frame") + half <= F.col("last_sample")) & (F.col("dead.frame") < F.coalesce("next_shot", F.lit(1 << 60)) + half), F.lit(False))
    reached = F.coalesce(F.col("bounce.frame") <= F.col("frame") + look, F.lit(False))
    out = ~(F.col("bounce.x").between(-1, 21) & F.col("bounce.y").between(-1, 45))
    reason = F.when(net, "net").when(reached & out, "out").when(reached & (F.coalesce("next_shot", F.lit(1 << 60)) - F.col("bounce.frame") >= pause), "not-returned")
    ends = rows.withColumn("reason", reason).filter("reason is not null").select("clip_id", F.when(F.col("reason") == "net", F.col("dead.frame")).otherwise(F.col("bounce.frame")).alias("end"), "reason", F.col("shot_id").alias("by_shot"), "hitter_side")
    # Sides since the last serve at or before an end: running counts over shots and ends.
    marks = shots.select("clip_id", F.col("frame").cast("long").alias("frame"), F.lit(0).alias("k"), F.col("is_serve").alias("serve"), F.col("hitter_side").alias("side"), none("string", "reason"), none("long", "by_shot")).unionByName(
        ends.select("clip_id", F.col("end").alias("frame"), F.lit(1).alias("k"), F.lit(False).alias("serve"), F.col("hitter_side").alias("side"), "reason", "by_shot"))
    upto = Window.partitionBy("clip_id").orderBy("frame", "k", "by_shot").rowsBetween(Window.unboundedPreceding, 0)
    point = marks.withColumn("serve_at", F.max(F.when(F.col("serve"), F.col("frame"))).over(upto))
    since = Window.partitionBy("clip_id", "serve_at").orderBy("frame", "k", "by_shot").rowsBetween(Window.unboundedPreceding, 0)
    hit = lambda side: F.max(F.when((F.col("k") == 0) & (F.col("side") == side), 1).otherwise(0)).over(since)
    crossed = point.withColumn("both", (hit("near") + hit("far")) == 2).filter("k = 1 and (reason = 'net' or serve_at is null or both)")
    return merge_ends(crossed.select("clip_id", "frame", "reason", "by_shot", F.col("side").alias("hitter_side")), pause)


def project_poses(poses: DataFrame, court: DataFrame, floor: float = 0.3) -> DataFrame:
    """The front foot of each pose by its own clip's court, before clips are joined: the visible ankle nearest the net (ties:
    the left one); null where neither is seen."""
    rows = poses.join(court, "clip_id")
    spots = [project(*point(a, floor)) for a in ("la", "ra")]
    options = F.filter(F.array(*[F.struct(F.abs(y - 22).alias("away"), F.lit(i).alias("place"), x.alias("x"), y.alias("y")) for i, (x, y) in enumerate(spots)]), lambda s: s["away"].isNotNull())
    return rows.withColumn("best", F.array_min(options)).select("clip_id", "frame", "track_id", F.col("best.x").alias("front_x"), F.col("best.y").alias("front_y"))


def category_counts(mix: DataFrame) -> DataFrame:
    """Per clip and category the match's count beside the user's and its share; ``mix`` is shot_mix (role null: the match)."""
    names = ["shots", "serve", "drive", "dink", "drop", "lob", "volleys", "forehands"]
    long = mix.unpivot(["clip_id", "role"], names, "category", "n")
    return long.filter("role is null or role = 'user'").groupBy("clip_id", "category").agg(F.max(F.when(F.col("role").isNull(), F.col("n"))).alias("match"), F.coalesce(F.max(F.when(F.col("role") == "user", F.col("n"))), F.lit(0)).alias("user")).withColumn(
        "user_share", F.try_divide("user", "match"))


def event_timeline(contacts: DataFrame, bounces: DataFrame) -> DataFrame:
    """Contacts and bounces of one arbitration in order: each contact is a volley if no bounce came since the one before.

    ``contacts(clip_id, frame, track_id)`` and ``bounces(clip_id, frame)`` are what suppression left of both together."""
    both = contacts.select("clip_id", "frame", F.lit("contact").alias("kind"), F.col("track_id").cast("long").alias("track_id")).unionByName(bounces.select("clip_id", "frame", F.lit("bounce").alias("kind"), F.lit(None).cast("long").alias("track_id")))
    w = Window.partitionBy("clip_id").orderBy("frame", "kind")
    before = F.lag("kind").over(w)
    return both.withColumn("volley", F.when(F.col("kind") == "contact", F.coalesce(before == "contact", F.lit(False)))).withColumn("seq", F.row_number().over(w) - 1)
