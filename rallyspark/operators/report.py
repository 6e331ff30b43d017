"""Blocks of a match report with their confidence: who owns the errors, technique, third shots, returns and serves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Events at which a small sample counts half, confidence of a count, and of what the camera can't measure.
HALF_AT, COUNTED, KNOWN_BAD = 8, 1.0, 0.2
#: Roles of the players, and reasons whose error is the last hitter's or the receivers'.
PLAYING = ("user", "partner", "opp_a", "opp_b")
HITTER, RECEIVER = ("ball-out", "net-or-short", "ball-off-frame"), ("double-bounce", "ball-not-returned")
#: Degrees of knee bend that are good for each kind of shot.
KNEE_BANDS = {"serve": (10, 30), "return": (10, 30), "drive": (20, 35), "drop": (30, 45), "dink": (35, 50)}


# ---- envelopes: {value, confidence, n, limited_by}

def shrink(n: Column) -> Column:
    """How far a sample of n counts: 0 of none, a half at HALF_AT, nearly 1 of many."""
    return F.when(n > 0, n / (n + HALF_AT)).otherwise(0.0)


def _envelope(value: Column, confidence: Column, n: Column, limit: Column) -> Column:
    return F.struct(value.alias("value"), confidence.alias("confidence"), n.cast("long").alias("n"), limit.alias("limited_by"))


def sourced(value: Column, mean_confidence: Column, n: Column, factor: Column | None = None) -> Column:
    """Backed by a confidence per event: their mean, shrunk by the sample, times ``factor``. What limits it is the lower of both."""
    base = F.coalesce(mean_confidence, F.lit(0.0))
    return _envelope(value, base * shrink(n) * (F.lit(1.0) if factor is None else factor), n, F.when(shrink(n) <= base, "sample_size").otherwise("measurement"))


def sampled(value: Column, n: Column) -> Column:
    return _envelope(value, shrink(n), n, F.lit("sample_size"))


def counted(value: Column, n: Column) -> Column:
    return _envelope(value, F.lit(COUNTED), n, F.lit("detection_floor"))


def known_limit(value: Column, n: Column) -> Column:
    return _envelope(value, F.lit(KNOWN_BAD), n, F.lit("known_limit"))


def positioned(value: Column, reliable_share: Column, frames: Column) -> Column:
    share = F.coalesce(reliable_share, F.lit(0.0))
    return _envelope(value, share * shrink(frames), frames, F.when(share <= shrink(frames), "measurement").otherwise("sample_size"))


# ---- errors

def role_confidence(roles: DataFrame) -> DataFrame:
    """The mean confidence of each playing role's tracks."""
    return roles.filter(F.col("role").isin(*PLAYING)).groupBy("clip_id", "role").agg(F.round(F.avg("role_confidence"), 6).alias("role_confidence"))


def _playing(roles: DataFrame, track: str, role: str) -> DataFrame:
    return roles.filter(F.col("role").isin(*PLAYING)).select("clip_id", F.col("track_id").alias(track), F.col("role").alias(role))


def error_owners(rallies: DataFrame, shots: DataFrame, roles: DataFrame) -> DataFrame:
    """Whose error ended each rally: clip_id, rally_id, end_reason, end_confidence, server_role, owner, kind, confidence.

    A serve fault is the server's; balls out, into the net or off the picture are the last hitter's; balls that bounce twice or
    don't come back are the receiving team's, by the side of the last hitter; anything else is unknown. Players without a role
    are ``unattributed``. The confidence is that of the reason times that of the owner's role, if it is a player."""
    last = shots.select("clip_id", F.col("shot_id").alias("last_shot"), F.col("track_id").alias("last_track"), "hitter_side")
    rows = (rallies.select("clip_id", "rally_id", "server", "last_shot", "end_reason", "end_confidence").join(last, ["clip_id", "last_shot"], "left")
            .join(_playing(roles, "server", "server_role"), ["clip_id", "server"], "left").join(_playing(roles, "last_track", "hitter_role"), ["clip_id", "last_track"], "left"))
    reason, nobody = F.col("end_reason"), F.lit("unattributed")
    team = F.when(F.col("hitter_side") == "near", "team_far").when(F.col("hitter_side") == "far", "team_near").otherwise("unknown")
    owner = F.when(reason == "serve-fault", F.coalesce("server_role", nobody)).when(reason.isin(*HITTER), F.coalesce("hitter_role", nobody)).when(reason.isin(*RECEIVER), team).otherwise("unknown")
    kind = F.when(reason == "serve-fault", "server").when(reason.isin(*HITTER), "hitter").when(reason.isin(*RECEIVER), "receiver").otherwise("unknown")
    owned = rows.withColumns({"owner": owner, "kind": kind}).join(role_confidence(roles).withColumnRenamed("role", "owner"), ["clip_id", "owner"], "left")
    return owned.select("clip_id", "rally_id", "end_reason", "end_confidence", "server_role", "owner", "kind", (F.col("end_confidence") * F.coalesce("role_confidence", F.lit(1.0))).alias("confidence"))


def errors_by_owner(owners: DataFrame) -> DataFrame:
    """Per clip, reason, owner and kind how many, beside the envelope of the clip's whole attribution."""
    whole = owners.groupBy("clip_id").agg(sourced(F.count("*"), F.avg("confidence"), F.count("*")).alias("e")).select("clip_id", F.col("e.confidence").alias("attribution_confidence"), F.col("e.limited_by").alias("limited_by"))
    return owners.groupBy("clip_id", "end_reason", "owner", "kind").agg(F.count("*").alias("n")).join(whole, "clip_id")


def player_report(owners: DataFrame, shots: DataFrame, rallies: DataFrame, roles: DataFrame) -> DataFrame:
    """Per clip and playing role: shots, returns, serves with faults, and errors, each with its envelope."""
    j = shots.join(_playing(roles, "track_id", "role"), ["clip_id", "track_id"])
    n = j.groupBy("clip_id", "role").agg(F.count("*").alias("shots"), F.count_if("is_serve").alias("serves"))
    second = rallies.select("clip_id", F.try_element_at("shot_ids", F.lit(2)).alias("shot_id")).filter("shot_id is not null").join(j.select("clip_id", "shot_id", "role"), ["clip_id", "shot_id"]).groupBy("clip_id", "role").agg(F.count("*").alias("returns"))
    served = owners.groupBy("clip_id", F.col("server_role").alias("role")).agg(F.count_if(F.col("end_reason") == "serve-fault").alias("faults"), F.avg("end_confidence").alias("served_confidence"))
    erred = owners.groupBy("clip_id", F.col("owner").alias("role")).agg(F.count("*").alias("errors"), F.avg("end_confidence").alias("error_confidence"))
    out = role_confidence(roles)
    for part in (n, second, served, erred):
        out = out.join(part, ["clip_id", "role"], "left")
    out = out.na.fill(0, ["shots", "serves", "returns", "faults", "errors"])
    rate = F.round(F.coalesce(F.try_divide("faults", "serves"), F.lit(0.0)), 4)
    return out.select("clip_id", "role", counted(F.col("shots"), F.col("shots")).alias("shots"), counted(F.col("returns"), F.col("returns")).alias("returns"),
                      sourced(F.struct("serves", "faults", rate.alias("fault_rate")), F.col("served_confidence"), F.col("serves"), F.col("role_confidence")).alias("serve"),
                      sourced(F.col("errors"), F.col("error_confidence"), F.col("errors"), F.col("role_confidence")).alias("errors"))


# ---- technique and third shots

def technique_report(shots: DataFrame, roles: DataFrame) -> DataFrame:
    """Contact in front of the body and knee bend, per clip (role null) and per clip and role: what (contact or knees), scope (all,
    a stroke side, dink, serve, or drives by side), n, good, share, mean.

    ``shots`` have contact_front (feet before the body) and knee_angle (degrees), null where no pose was seen. Contacts are good
    in front, knees within the band of the kind of shot; a kind without a band is never good."""
    bend, kind, side = 180 - F.col("knee_angle"), F.col("shot_type"), F.col("stroke_side")
    good = F.coalesce(F.element_at(F.create_map(*[x for k, (a, b) in KNEE_BANDS.items() for x in (F.lit(k), bend.between(a, b))]), kind), F.lit(False))
    row = lambda test, what, scope, value, ok: F.when(test & value.isNotNull(), F.struct(F.lit(what).alias("what"), scope.alias("scope"), value.cast("double").alias("v"), ok.alias("ok")))
    front, yes = F.col("contact_front"), F.lit(True)
    sides = side.isin("forehand", "backhand")
    rows = F.array(row(yes, "contact", F.lit("all"), front, front > 0), row(sides, "contact", side, front, front > 0), row(yes, "knees", F.lit("all"), bend, good), row(kind.isin("dink", "serve"), "knees", kind, bend, good),
                   row((kind == "drive") & sides, "knees", F.concat(F.lit("drive "), side), bend, good))
    j = shots.join(_playing(roles, "track_id", "role"), ["clip_id", "track_id"], "left").select("clip_id", "role", F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("r")).select("clip_id", "role", "r.*")
    each = lambda by: j.groupBy("clip_id", *by, "what", "scope").agg(F.count("*").alias("n"), F.count_if("ok").alias("good"), F.avg("v").alias("mean"))
    both = each([]).withColumn("role", F.lit(None).cast("string")).unionByName(each(["role"]).filter("role is not null"))
    return both.select("clip_id", "role", "what", "scope", "n", "good", F.round(F.col("good") / F.col("n"), 2).alias("share"), F.round("mean", 2).alias("mean"))


def third_shot_report(rallies: DataFrame, shots: DataFrame, roles: DataFrame) -> DataFrame:
    """Third shots of rallies of three or more that are a drop or a drive from deep, no serve: how many of either, the share of
    drops and its envelope, per clip (role null) and per clip and role. ``shots`` have contact_zone."""
    third = rallies.filter("n_shots >= 3").select("clip_id", F.try_element_at("shot_ids", F.lit(3)).alias("shot_id")).filter("shot_id is not null")
    deep = shots.filter("not is_serve and shot_type in ('drop', 'drive') and contact_zone in ('baseline', 'transition')")
    j = third.join(deep, ["clip_id", "shot_id"]).join(_playing(roles, "track_id", "role"), ["clip_id", "track_id"], "left")
    is_drop = (F.col("shot_type") == "drop").cast("int")
    each = lambda by: j.groupBy("clip_id", *by).agg(F.count("*").alias("n"), F.sum(is_drop).alias("drops"), F.round(F.avg(is_drop), 3).alias("drop_rate"), F.avg("confidence").alias("c"))
    both = each([]).withColumn("role", F.lit(None).cast("string")).unionByName(each(["role"]).filter("role is not null"))
    rows = both.withColumn("e", sourced(F.col("drop_rate"), F.col("c"), F.col("n")))
    return rows.select("clip_id", "role", "n", "drops", (F.col("n") - F.col("drops")).alias("drives"), "drop_rate", F.col("e.confidence").alias("confidence"), F.col("e.limited_by").alias("limited_by"))
