"""Ratings with the evidence behind them, and what a plan makes of them: focus, strength or not assessable, and drills.

A category is as sure as the weakest of the metrics that drive it, and that metric names what limits it. What rests on too
little is neither a weakness nor a strength. The height of the paddle at the net isn't measured, so no drill asks for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.readers import written
from . import metrics as M
from .report import positioned, role_confidence, sampled, sourced

#: Confidence of a stroke with and without a read contact, and the factor of a synthetic ball.
STROKE_READ, STROKE_COUNTED, SYNTHETIC = 0.30, 0.05, 0.35
#: Confidence from which a category is measured or assessed at all, and the fewest events to coach a rate.
MEASURED_FROM, ASSESSED_FROM, LEAST_EVENTS = 0.50, 0.10, 6
#: Focus areas of a plan, and the part of a priority that doesn't depend on confidence.
TOP, UNSURE_PART = 6, 0.5
#: The metrics that drive each category (the first of equals names the limit).
EVIDENCE = {"strategy": ("position", "team"), "third_shot": ("third",), "dink": ("type", "length"), "volley": ("volley",), "serve_return": ("serve",), "forehand": ("side",), "backhand": ("side",)}
#: The events that a category rests on.
EVENTS = {"third_shot": "thirds", "dink": "dinks", "volley": "volleys", "serve_return": "serves", "forehand": "forehands", "backhand": "backhands"}
#: What a finding is about, and where it stops being low and begins to be high.
FINDINGS = {"strategy": ("kitchen", 0.25, 0.45), "third_shot": ("drop_rate", 0.35, 0.65), "dink": ("dink_share", 0.10, 0.30), "serve_return": ("fault_rate", 0.05, 0.15)}
#: Drills in the order of their choice, with the SQL test that asks for each. At most DRILLS_EACH are given.
DRILLS_EACH = 3
DRILLS = {
    "strategy": [("get_to_line", "true"), ("move_as_unit", "coalesce(both_kitchen, 0) < 0.30"), ("transition_resets", "coalesce(transition, 0) > 0.25"), ("split_step_recover", "true")],
    "third_shot": [("third_shot_drop_reps", "true")],
    "dink": [("coop_dink_count", "true"), ("soft_game_targets", "true"), ("loaded_stance", "dink_knee < 0.6")],
    "volley": [("volley_exchanges", "true"), ("reset_under_pressure", "true")],
    "serve_return": [("deep_serve_targets", "coalesce(fault_rate, 0) > 0.1"), ("pre_serve_routine", "true")],
    "forehand": [("contact_in_front", "forehand_ahead < 0.7"), ("loaded_stance", "forehand_knee < 0.5"), ("contact_in_front", "coalesce(forehand_ahead >= 0.7, true)")],
    "backhand": [("contact_in_front", "backhand_ahead < 0.7"), ("loaded_stance", "backhand_knee < 0.5"), ("contact_in_front", "coalesce(backhand_ahead >= 0.7, true)")],
}


def _to(x: Column, places: int) -> Column:
    """Rounded to nine places first, so that a tie doesn't depend on the order in which a mean was summed."""
    return F.round(F.round(x, 9), places)


def _sure(envelope: Column, name: str) -> Column:
    return F.struct(envelope["confidence"].alias("confidence"), envelope["limited_by"].alias("limited_by")).alias(f"{name}_e")


def _deep_third() -> Column:
    """A third shot that is a decision: a drop or a drive from deep, no serve."""
    return (F.col("seq") == 3) & ~F.col("is_serve") & F.col("shot_type").isin("drop", "drive") & F.col("contact_zone").isin("baseline", "transition")


def evidence(shots: DataFrame, roles: DataFrame, players: DataFrame, rallies: DataFrame) -> DataFrame:
    """One row per clip and role: {confidence, limited_by} of each metric in EVIDENCE as ``<metric>_e``, counts of the events, and the
    role's own deep third shots. ``shots`` have contact_zone and front (contact before the hip).

    Third shots, team and rally length are the clip's, the rest is the role's; a metric without a row has confidence 0."""
    c, side, third = F.col("confidence"), F.col("stroke_side"), _deep_third()
    ahead = [F.avg(F.when((side == s) & F.col("front").isNotNull(), (F.col("front") > 0).cast("int"))).alias(f"{s}_ahead") for s in ("forehand", "backhand")]
    own = shots.join(roles.filter("role <> 'noise'"), ["clip_id", "track_id"]).groupBy("clip_id", "role").agg(
        _sure(sourced(F.lit(None), F.avg(c), F.count("*")), "type"), _sure(sourced(F.lit(None), F.avg(F.when(side.isNotNull(), c)), F.count(side)), "side"),
        _sure(sourced(F.lit(None), F.avg(F.when(F.col("is_volley"), c)), F.count_if("is_volley")), "volley"),
        F.count_if("is_serve").alias("n_serves"), F.avg(F.when(F.col("is_serve"), c)).alias("serve_c"), F.count_if(third).alias("thirds"),
        F.avg(F.when(third, (F.col("shot_type") == "drop").cast("int"))).alias("drop_rate"), F.count_if(F.col("shot_type") == "dink").alias("dinks"), F.count_if("is_volley").alias("volleys"),
        F.count_if(side == "forehand").alias("forehands"), F.count_if(side == "backhand").alias("backhands"), *ahead)
    thirds = shots.filter(third).groupBy("clip_id").agg(_sure(sourced(F.lit(None), F.avg(c), F.count("*")), "third"))
    lengths = rallies.groupBy("clip_id").agg(_sure(sampled(F.lit(None), F.count("*")), "length"))
    seen = players.join(roles.filter("role <> 'noise'"), ["clip_id", "track_id"])
    fit = lambda ok: F.avg(ok.cast("int"))
    places = seen.groupBy("clip_id", "role").agg(_sure(positioned(F.lit(None), fit(~F.col("transient")), F.count("*")), "position"))
    both = (seen.filter("role in ('user', 'partner')").groupBy("clip_id", "frame").agg(F.count_distinct("role").alias("roles"), F.bool_and(~F.col("transient")).alias("ok"))
            .filter("roles = 2").groupBy("clip_id").agg(_sure(positioned(F.lit(None), fit(F.col("ok")), F.count("*")), "team")))
    rows = (own.join(places, ["clip_id", "role"], "left").join(role_confidence(roles), ["clip_id", "role"], "left").join(thirds, "clip_id", "left").join(lengths, "clip_id", "left").join(both, "clip_id", "left"))
    return rows.withColumn("serve_e", _sure(sourced(F.lit(None), F.col("serve_c"), F.col("n_serves"), F.coalesce("role_confidence", F.lit(1.0))), "serve")).drop("n_serves", "serve_c", "role_confidence")


def categories(drivers: DataFrame, proofs: DataFrame, clips: DataFrame) -> DataFrame:
    """One row per clip, role and category: level, weight, confidence, limited_by, data_source, coverage, events, and the drivers.

    ``drivers`` is rating_drivers of positions inside rallies, ``proofs`` is evidence(); ``clips`` has clip_id and synthetic. The third
    shots that count are those of ``proofs``. A category with a count is at least partly covered. What they are rated by, a row per
    clip and role, is written once: levels and plans come back to it, not to the shots."""
    d = written(drivers.drop("thirds", "drop_rate").join(proofs, ["clip_id", "role"]).withColumn("fault_rate", F.try_divide("faults", "serves")))
    none = F.struct(F.lit(0.0).alias("confidence"), F.lit("measurement").alias("limited_by"))
    proof = lambda name: F.coalesce(F.col(f"{name}_e"), none)
    weakest = lambda names: F.array_min(F.array(*[F.struct(proof(n)["confidence"].alias("c"), F.lit(i).alias("at"), proof(n)["limited_by"].alias("why")) for i, n in enumerate(names)]))
    count = lambda k: F.col(EVENTS[k]).cast("long") if k in EVENTS else F.lit(None).cast("long")
    per = F.explode(F.array(*[F.struct(F.lit(k).alias("category"), F.lit(i).alias("place"), weakest(names).alias("w"), count(k).alias("events"),
                                       (F.col(f"{k}_n") > 0 if k in ("forehand", "backhand") else F.lit(None).cast("boolean")).alias("read")) for i, (k, names) in enumerate(EVIDENCE.items())])).alias("e")
    rows = d.select("*", per).select(*d.columns, "e.*").join(M.score_categories(d).select("clip_id", "role", "category", "level", "weight"), ["clip_id", "role", "category"]).join(clips, "clip_id")
    fake = F.col("synthetic") & (F.col("category") != "strategy")
    cap = F.when(F.col("read"), STROKE_READ).when(~F.col("read"), STROKE_COUNTED).otherwise(1.0)
    rows = rows.withColumn("confidence", _to(F.least(F.col("w.c") * F.when(fake, SYNTHETIC).otherwise(1.0), cap), 4))
    counted = (F.col("category") != "third_shot") & (F.coalesce("events", F.lit(0)) > 0)
    cover = F.when(F.col("confidence") >= MEASURED_FROM, "measured").when((F.col("confidence") >= ASSESSED_FROM) | counted, "partial").otherwise("not_assessable")
    return rows.withColumns({"limited_by": F.col("w.why"), "data_source": F.when(fake, "synthetic").otherwise("real"), "coverage": cover}).drop("w", "read", "synthetic", *[c for c in d.columns if c.endswith("_e")])


def plan(rated: DataFrame) -> DataFrame:
    """One row per clip, role and category of categories(): ``route`` is focus, strength, not_assessable, or later (a focus below
    the first TOP), against the next half step above the rating's band. Focus areas have a gap, priority, rank, finding (low,
    mid or high) and drills; all have what they were judged by. Of equal priorities the category listed first leads."""
    band = F.greatest(F.lit(1.0), F.least(F.lit(5.0), M.half_step(F.round("rating", 9))))
    goals = M.overall_rating(rated).select("clip_id", "role", F.least(F.lit(5.0), band + 0.5).alias("target"))
    rows = rated.join(goals, ["clip_id", "role"])
    blind = (F.col("data_source") == "real") & ((F.col("confidence") < ASSESSED_FROM) | F.coalesce(F.col("events") < LEAST_EVENTS, F.lit(False)))
    first = F.when(blind, "not_assessable").when(F.col("level") >= F.col("target"), "strength").otherwise("focus")
    gap = F.col("target") - F.col("level")
    priority = _to(gap * F.col("weight") * (UNSURE_PART + (1 - UNSURE_PART) * F.col("confidence")), 4)
    order = F.row_number().over(Window.partitionBy("clip_id", "role", "first").orderBy(F.desc("priority"), "place"))
    finding = drills = F.lit(None)
    for k, (value, lo, hi) in FINDINGS.items():
        finding = F.when((F.col("category") == k) & F.col(value).isNotNull(), F.when(F.col(value) < lo, "low").when(F.col(value) >= hi, "high").otherwise("mid")).otherwise(finding)
    for k, choices in DRILLS.items():
        asked = F.filter(F.array(*[F.when(F.expr(test), F.lit(name)) for name, test in choices]), lambda x: x.isNotNull())
        drills = F.when(F.col("category") == k, F.array_join(F.slice(asked, 1, DRILLS_EACH), ",")).otherwise(drills)
    rows = rows.withColumn("first", first).withColumn("priority", F.when(F.col("first") == "focus", priority)).withColumn("rank", F.when(F.col("first") == "focus", order).cast("long"))
    on = lambda c: F.when(F.col("first") == "focus", c)
    return rows.select("clip_id", "role", "category", "level", "confidence", "limited_by", "coverage", "events", "target", F.when(F.col("rank") > TOP, "later").otherwise(F.col("first")).alias("route"),
                       on(_to(gap, 3)).alias("gap"), "priority", "rank", on(finding).alias("finding"), on(drills).alias("drills"))
