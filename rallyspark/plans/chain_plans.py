"""Queries on sources, per-clip parameters, the shot chain, scoring and rally ends, with SQL twins where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chain as C
from ..operators import helpers as H
from ..operators import params as P
from ..operators import scoring as S
from ..operators import shots as D
from ..sources import readers as R


def _long(df, **names):
    """Columns as longs under new names."""
    return df.select("clip_id", *[F.expr(e).cast("long").alias(n) for n, e in names.items()])


def register(add, raw) -> None:
    """``add(name, run, sql)`` as in the registry; ``raw(name, run, sql)`` where ``run`` needs the session too."""
    # ---- sources: what Spark derives from the tables is written as clip folders and read back
    def stream(spark, get):
        folder = R.shared_folder(spark)
        get("ball").withColumn("clip", F.col("clip_id")).drop("clip_id").write.partitionBy("clip").parquet(folder)
        return R.read_stream(spark, f"{folder}/*/*.parquet", ["frame", "visible", "pixel_x", "pixel_y"], ("court_pos_reliable",)).select("clip_id", "frame", "visible", "pixel_x", "pixel_y", F.col("court_pos_reliable").isNull().alias("optional_missing"))

    raw("s1_read_stream", stream, "SELECT clip_id, frame, visible, pixel_x, pixel_y, true AS optional_missing FROM fx_ball")

    def events(spark, get):
        folder = R.shared_folder(spark)
        doc = F.to_json(F.struct(F.lit(1).alias("schema_version"), F.lit(60.0).alias("fps"), F.sort_array(F.collect_list(F.struct("shot_id", "frame", "hitter_side", "is_serve"))).alias("shots")))
        get("shots").groupBy(F.col("clip_id").alias("clip")).agg(doc.alias("value")).write.partitionBy("clip").text(folder)  # a document is one clip
        return R.read_events(spark, f"{folder}/*/*.txt", "shots", "shot_id long, frame long, hitter_side string, is_serve boolean")

    raw("s2_read_events", events, "SELECT clip_id, 1 AS schema_version, 60.0E0 AS fps, shot_id, frame, hitter_side, is_serve FROM fx_shots")

    def labels(spark, get):
        folder = R.shared_folder(spark)
        tenths = F.floor(F.col("frame") / 6)
        clock = F.format_string("%02d:%02d.%d", F.floor(tenths / 600), F.floor(tenths % 600 / 10), tenths % 10)
        sheet = get("truth").select(F.col("clip_id").alias("clip"), F.when(F.col("truth_id") % 2 == 0, F.col("frame").cast("string")).alias("frame"), clock.alias("time"), F.when(F.col("truth_id") % 11 != 0, F.initcap("true_type")).alias("true_type"))
        sheet.filter("frame is not null or time is not null").write.partitionBy("clip").option("header", "true").csv(folder)
        return R.read_labels_csv(spark, f"{folder}/*/*.csv", get("court")).groupBy("clip_id", "frame", "true_type").agg(F.count("*").alias("n"))

    raw("s3_read_labels_csv", labels, """t AS (SELECT clip_id, CASE WHEN truth_id % 2 = 0 THEN frame ELSE CAST(round_even(CAST(floor(frame / 6) AS DOUBLE) / 10 * fps, 0) AS BIGINT) END AS frame, true_type FROM fx_truth JOIN fx_court USING (clip_id) WHERE truth_id % 11 <> 0)
    SELECT clip_id, frame, true_type, count(*) AS n FROM t GROUP BY ALL""")

    def written(spark, get):
        folder = R.shared_folder(spark)
        R.write_table(get("rallies").select("clip_id", "rally_id", "start_frame"), folder, by="clip_id")
        return spark.read.parquet(folder).select(F.col("clip_id").cast("long").alias("clip_id"), "rally_id", "start_frame", "schema_version", "stage_version")

    raw("s4_write_table", written, "SELECT clip_id, rally_id, start_frame, 1 AS schema_version, '1.0.0' AS stage_version FROM fx_rallies")

    docs = lambda get: get("roles").select("clip_id", F.concat(F.lit("s"), F.col("track_id") % 2).alias("source"), F.when((F.col("clip_id") % 7 == 3) & (F.col("track_id") == 4), 2).otherwise(1).alias("schema_version"), F.when(F.col("clip_id") % 11 != 5, 60.0 + F.when(F.col("clip_id") % 5 == 2, F.col("track_id") / 8).otherwise(0.0)).alias("fps"))
    add("s6_check_schema_version", lambda get: P.check_schema_version(docs(get), 1), """d AS (SELECT clip_id, CASE WHEN clip_id % 7 = 3 AND track_id = 4 THEN 2 ELSE 1 END AS v, CASE WHEN clip_id % 11 <> 5 THEN 60 + CASE WHEN clip_id % 5 = 2 THEN track_id / 8 ELSE 0 END END AS fps FROM fx_roles),
    g AS (SELECT clip_id, CASE WHEN bool_or(v <> 1) THEN 'version' WHEN bool_or(coalesce(fps <= 0, true)) THEN 'no frame rate' WHEN max(fps) - min(fps) > 0.5 THEN 'frame rates differ' END AS fault FROM d GROUP BY clip_id) SELECT * FROM g WHERE fault IS NOT NULL""")
    odd = lambda get: get("labels").select("clip_id", F.col("frame").alias("seq"), (F.col("frame") - F.when(F.col("frame") % 28 == 0, 8).otherwise(0)).alias("frame"), F.when(F.col("frame") % 44 != 0, F.col("ball_visible")).alias("ball_visible"),
                                           (F.col("label_x") + F.when(F.col("frame") % 36 == 0, 3000).otherwise(0)).alias("label_x"), F.when(F.col("frame") % 52 != 0, F.col("label_y")).alias("label_y"))
    clips = lambda get: get("labels").groupBy("clip_id").agg((F.max("frame") - 40).alias("n_frames")).withColumns({"frame_width": F.lit(1920), "frame_height": F.lit(1080)})
    add("s7_check_labels", lambda get: P.check_labels(odd(get), clips(get), 150), """l AS (SELECT clip_id, frame AS seq, frame - CASE WHEN frame % 28 = 0 THEN 8 ELSE 0 END AS frame, CASE WHEN frame % 44 <> 0 THEN ball_visible END AS v, label_x + CASE WHEN frame % 36 = 0 THEN 3000 ELSE 0 END AS x, CASE WHEN frame % 52 <> 0 THEN label_y END AS y FROM fx_labels),
    k AS (SELECT clip_id, max(frame) - 40 AS n_frames, count(*) AS n FROM fx_labels GROUP BY clip_id), r AS (SELECT l.*, n_frames, lag(frame) OVER (PARTITION BY l.clip_id ORDER BY seq) AS b FROM l JOIN k USING (clip_id)),
    f AS (SELECT clip_id, frame, unnest([CASE WHEN frame IS NULL OR v IS NULL THEN 'missing field' END, CASE WHEN frame < 0 THEN 'negative frame' END, CASE WHEN frame <= b THEN 'not increasing' END, CASE WHEN frame >= n_frames THEN 'past the end' END, CASE WHEN v AND (x IS NULL OR y IS NULL) THEN 'visible without place' END,
      CASE WHEN NOT v AND (x IS NOT NULL OR y IS NOT NULL) THEN 'place without ball' END, CASE WHEN v AND NOT (x >= 0 AND x < 1920 AND y >= 0 AND y < 1080) THEN 'outside the picture' END]) AS fault FROM r)
    SELECT * FROM f WHERE fault IS NOT NULL UNION ALL SELECT clip_id, NULL AS frame, 'too few labels' AS fault FROM k WHERE n < 150""")
    whole = lambda e: f"CAST(round_even({e}, 0) AS INT)"
    add("s8_scaled_params", lambda get: P.scaled_params(get("court")), "SELECT clip_id, fps, " + ", ".join([*[f"{v}E0 * (frame_width / 1920) AS {k}" for k, v in P.PIXELS.items()], *[f"greatest(1, {whole(f'{v} * (fps / 30)')}) AS {k}" for k, v in P.FRAMES.items()],
                                                                                                            *[f"{whole(f'{v}E0 * fps')} AS {k}" for k, v in P.SECONDS.items()], f"greatest(2, {whole('0.13E0 * fps')}) AS min_serve_run FROM fx_court"]))

    # ---- the shot chain
    court = lambda get: get("court").withColumn("real", F.col("clip_id") % 4 != 0)
    wrists = lambda get: get("poses").select("clip_id", "frame", "track_id", F.explode(F.array(*[F.when(F.col(f"{s}wv") >= 0.5, F.struct(F.col(f"{s}wx").alias("wx"), F.col(f"{s}wy").alias("wy"))) for s in "lr"])).alias("w")).filter("w is not null").select("clip_id", "frame", "track_id", "w.*")
    add("d5_detect_shots", lambda get: C.detect_shots(get("ball"), get("chasers"), court(get), wrists(get)))
    add("d13_event_timeline", lambda get: timeline(get))
    add("b1_select_track", lambda get: H.select_track(get("candidates")))
    balls = lambda get: get("ball").filter("visible").select("clip_id", "frame", F.col("pixel_x").alias("x"), F.col("pixel_y").alias("y"))
    add("b20_follow_shot", lambda get: H.follow_shot(get("shots").select("clip_id", "shot_id", "frame").join(balls(get), ["clip_id", "frame"]), get("ball")))

    def timeline(get):
        ball = get("ball")
        cands = D.impulse_candidates(ball).select("clip_id", "frame", "score").unionByName(D.bounce_candidates(ball).select("clip_id", "frame", (F.col("score") / 400).alias("score"))).groupBy("clip_id", "frame").agg(F.max("score").alias("score"))
        kept = H.suppress_neighbours(cands, 6).join(balls(get), ["clip_id", "frame"]).join(P.scaled_params(get("court")).select("clip_id", "assoc_min_px", "assoc_max_px"), "clip_id")
        contacts = C.nearest_player(kept, get("players"))
        return S.event_timeline(contacts, kept.join(contacts.select("clip_id", "frame"), ["clip_id", "frame"], "left_anti"))

    # ---- scoring
    shots = lambda get: get("shots").withColumn("is_user", F.col("track_id") < 3)
    kind = "CASE WHEN shot_id % 7 = 1 THEN 'false_positive' WHEN shot_id % 7 = 3 THEN 'missed' WHEN shot_id % 7 = 5 THEN 'wrong_player' END"
    review = lambda get: get("shots").select("clip_id", F.col("shot_id").alias("truth_id"), F.expr(kind).alias("kind"), F.expr("frame + shot_id % 90 - 45 + CASE WHEN shot_id % 5 = 0 THEN 60 ELSE 0 END").alias("frame"),
                                             F.expr("CASE shot_id % 3 WHEN 0 THEN 'feed' WHEN 1 THEN 'roll' ELSE 'other court' END").alias("cause"), F.expr("CASE WHEN shot_id % 2 = 0 THEN 'user' ELSE 'partner' END").alias("said")).filter("kind is not null")
    add("e2_score_shots", lambda get: S.score_shots(shots(get), review(get)))
    add("e2_false_causes", lambda get: S.false_causes(shots(get), review(get)))
    serves = lambda get, e: get("shots").filter("is_serve").select("clip_id", F.expr(e).alias("frame"), F.col("shot_id").alias("id"))
    add("e3_score_serves", lambda get: S.score_serves(get("rallies").select("clip_id", F.col("start_frame").alias("frame"), F.col("rally_id").alias("id")), serves(get, "frame + shot_id % 400 - 150"), serves(get, "frame + shot_id % 60")))
    counts = lambda get: S.clip_counts(shots(get), get("bounces"), get("rallies"))
    other = lambda get, e: counts(get).withColumn("value", F.expr(e)).filter("value is not null")
    truth, was = "CASE WHEN metric <> 'rallies' THEN value + clip_id % 5 - 2 END", "CASE WHEN metric <> 'dinks' THEN value + (clip_id + length(metric)) % 7 - 3 END"
    ct = """cw AS (SELECT clip_id, """ + ", ".join(f"count_if({t.replace('is_user', '(track_id < 3)')}) AS {k}" for k, t in S.COUNTS.items()) + """ FROM fx_shots GROUP BY clip_id), bn AS (SELECT clip_id, count(*) AS bounces FROM fx_bounces GROUP BY clip_id), rn AS (SELECT clip_id, count(*) AS rallies FROM fx_rallies GROUP BY clip_id),
    ct AS (UNPIVOT (SELECT * FROM cw LEFT JOIN bn USING (clip_id) LEFT JOIN rn USING (clip_id)) ON """ + ", ".join([*S.COUNTS, "bounces", "rallies"]) + f""" INTO NAME metric VALUE value),
    cj AS (SELECT clip_id, metric, value AS got, {truth} AS truth, {was} AS was FROM ct)"""
    add("e6_acceptance", lambda get: S.acceptance(counts(get), other(get, truth), other(get, was)), ct + """ SELECT clip_id, metric, got, truth, got - truth AS error, abs(got - truth) / nullif(truth, 0) AS error_share,
      CASE WHEN was IS NULL THEN NULL WHEN was = got THEN 'unchanged' WHEN truth IS NULL THEN 'moved' WHEN abs(got - truth) < abs(was - truth) THEN 'better' WHEN abs(got - truth) > abs(was - truth) THEN 'worse' ELSE 'same error' END AS move FROM cj""")
    add("e6_acceptance_summary", lambda get: S.acceptance_summary(counts(get), other(get, truth)), ct + """ SELECT clip_id, count(truth) AS scored, round(avg(abs(got - truth) / nullif(truth, 0)), 9) AS mean_error,
      CAST(sum(CASE metric WHEN 'shots' THEN got WHEN 'volleys' THEN -got WHEN 'bounces' THEN -got ELSE 0 END) AS BIGINT) AS identity_gap FROM cj GROUP BY clip_id""")
    sheet = lambda get: get("shots").select("clip_id", F.col("shot_id").alias("label_id"), F.expr("frame + shot_id % 9 - 4").alias("frame"), F.expr("shot_id % 3 = 0").alias("by_clock"), F.expr("CASE WHEN shot_id % 10 = 0 THEN '' WHEN shot_id % 13 = 0 THEN 'Between pts' WHEN shot_id % 6 = 0 THEN 'drive' ELSE shot_type END").alias("true_type"),
                                            F.expr("CASE WHEN shot_id % 20 = 0 THEN 'a feed' END").alias("notes"), F.expr("CASE shot_id % 4 WHEN 0 THEN 'y' WHEN 1 THEN 'N' ELSE '' END").alias("true_volley"))
    tl = """lb AS (SELECT clip_id, shot_id AS label_id, frame + shot_id % 9 - 4 AS at_, CASE WHEN shot_id % 3 = 0 THEN 4 ELSE 3 END AS reach, lower(CASE WHEN shot_id % 10 = 0 THEN '' WHEN shot_id % 13 = 0 THEN 'Between pts' WHEN shot_id % 6 = 0 THEN 'drive' ELSE shot_type END) AS truth, shot_id % 20 = 0 AS noted,
      CASE shot_id % 4 WHEN 0 THEN 'y' WHEN 1 THEN 'n' ELSE '' END AS tv FROM fx_shots),
    lk AS (SELECT *, CASE WHEN truth = 'between pts' OR (truth = '' AND noted) THEN false WHEN truth <> '' THEN true END AS is_shot FROM lb),
    ls AS (SELECT l.clip_id, label_id, min({'d': abs(s.frame - at_), 'f': s.frame, 'i': s.shot_id, 't': s.shot_type, 'v': s.is_volley}) AS s FROM lk l JOIN fx_shots s ON s.clip_id = l.clip_id AND s.frame BETWEEN at_ - reach AND at_ + reach GROUP BY ALL),
    tl AS (SELECT lk.*, coalesce(s.t, 'not-detected') AS said, CASE WHEN is_shot AND tv <> '' THEN (tv = 'y') = coalesce(s.v, false) END AS volley_right FROM lk LEFT JOIN ls USING (clip_id, label_id) WHERE is_shot IS NOT NULL)"""
    add("e21_type_report", lambda get: S.type_report(get("shots"), sheet(get)), tl + """, x AS (SELECT clip_id, truth AS type, 1 AS t, 0 AS p, CAST(truth = said AS INT) AS ok FROM tl WHERE is_shot UNION ALL SELECT clip_id, said AS type, 0 AS t, 1 AS p, 0 AS ok FROM tl WHERE is_shot),
    g AS (SELECT clip_id, type, CAST(sum(t) AS BIGINT) AS n, CAST(sum(p) AS BIGINT) AS n_said, CAST(sum(ok) AS BIGINT) AS "right" FROM x GROUP BY clip_id, type), h AS (SELECT *, coalesce("right" / nullif(n_said, 0), 0) AS precision, coalesce("right" / nullif(n, 0), 0) AS recall FROM g)
    SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1 FROM h""")
    add("e21_type_confusion", lambda get: S.type_confusion(get("shots"), sheet(get)), tl + " SELECT clip_id, truth, said, count(*) AS n FROM tl WHERE is_shot GROUP BY ALL")
    add("e21_type_accuracy", lambda get: S.type_accuracy(get("shots"), sheet(get)), tl + """ SELECT clip_id, count_if(is_shot) AS real_shots, count_if(NOT is_shot) AS not_shots, count_if(NOT is_shot AND said <> 'not-detected') AS not_shots_detected,
      avg(CASE WHEN is_shot THEN CAST(truth = said AS INT) END) AS type_accuracy, avg(CAST(volley_right AS INT)) AS volley_accuracy FROM tl GROUP BY clip_id""")
    add("e23_rally_report", lambda get: S.rally_report(get("rallies").select("clip_id", F.col("rally_id").alias("id"), F.col("start_frame").alias("frame"), F.col("end_reason").alias("reason")),
                                                       get("rallies").select("clip_id", F.col("rally_id").alias("id"), F.expr("start_frame + rally_id % 17 - 8").alias("frame"), F.expr("CASE WHEN rally_id % 4 = 0 THEN 'net' ELSE end_reason END").alias("reason"))))
    lands = lambda get, e, c: get("bounces").select("clip_id", F.col("bounce_id").alias("id"), F.expr(e).alias("frame"), F.expr(c).alias("is_in"))
    add("e23_bounce_report", lambda get: S.bounce_report(lands(get, "frame", "court_x_ft between 0 and 20 and court_y_ft between 0 and 44"), lands(get, "frame + bounce_id % 17 - 8", "court_x_ft between 0 and 20 and court_y_ft between 0 and 43")))
    hits = lambda get: get("played").select("clip_id", "shot_id", "frame", "hitter_side", F.expr("cast(case when hitter_side = 'near' then pk % 20 - 3 else 47 - pk % 20 end as double)").alias("hitter_y"))
    add("d11_point_gaps", lambda get: C.point_marks(hits(get), P.scaled_params(get("court")).withColumn("real", F.lit(True))).select("clip_id", "shot_id", "returned", "candidate", "is_end"), """s AS (SELECT clip_id, shot_id, frame, hitter_side, CASE WHEN hitter_side = 'near' THEN pk % 20 - 3 ELSE 47 - pk % 20 END AS y, fps FROM fx_played JOIN fx_court USING (clip_id)),
    n AS (SELECT *, min(CASE WHEN hitter_side = 'near' THEN frame END) OVER w AS nn, min(CASE WHEN hitter_side = 'far' THEN frame END) OVER w AS nf, frame - lag(frame) OVER o AS gb, lead(frame) OVER o - frame AS ga FROM s WINDOW w AS (PARTITION BY clip_id ORDER BY frame RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), o AS (PARTITION BY clip_id ORDER BY frame)),
    m AS (SELECT *, coalesce(CASE WHEN hitter_side = 'near' THEN nf ELSE nn END - frame <= 2.5 * fps, false) AS returned, abs(y - 22) >= 21 AND coalesce(gb >= 3 * fps, true) AS candidate FROM n)
    SELECT clip_id, shot_id, returned, candidate, NOT candidate AND NOT returned AND coalesce(ga >= 3 * fps, true) AS is_end FROM m""")
    feet = lambda get: get("ball").filter("visible or interpolated").select("clip_id", "frame", (F.col("pixel_x") / 60 - 3).alias("x"), (F.col("pixel_y") / 20 - 5).alias("y"), (F.abs(F.col("frame") * 7 % 80 - 40) / 10).alias("z"))
    add("r8_rally_ends", lambda get: S.rally_ends(get("shots"), feet(get), get("bounces").select("clip_id", "frame")), """sm AS (SELECT clip_id, frame, pixel_x / 60 - 3 AS x, pixel_y / 20 - 5 AS y, abs(frame * 7 % 80 - 40) / 10 AS z FROM fx_ball WHERE visible OR interpolated),
    dw AS (SELECT *, avg(CAST(z <= 1 AND abs(y - 22) <= 8 AS INT)) OVER w >= 0.65 AND greatest(max(x) OVER w - min(x) OVER w, max(y) OVER w - min(y) OVER w) <= 6 AS dead FROM sm WINDOW w AS (PARTITION BY clip_id ORDER BY frame RANGE BETWEEN CURRENT ROW AND 30 FOLLOWING)),
    dd AS (SELECT clip_id, frame FROM dw WHERE dead), bf AS (SELECT DISTINCT clip_id, frame FROM fx_bounces),
    bn AS (SELECT b.clip_id, b.frame, p.frame AS pf, p.x AS px, p.y AS py, n.frame AS nf, n.x AS nx, n.y AS ny FROM bf b ASOF LEFT JOIN sm p ON p.clip_id = b.clip_id AND b.frame >= p.frame ASOF LEFT JOIN sm n ON n.clip_id = b.clip_id AND b.frame <= n.frame),
    bp AS (SELECT clip_id, frame, CASE WHEN pf IS NULL OR nf - frame < frame - pf THEN nx ELSE px END AS x, CASE WHEN pf IS NULL OR nf - frame < frame - pf THEN ny ELSE py END AS y FROM bn WHERE pf IS NOT NULL OR nf IS NOT NULL),
    sh AS (SELECT clip_id, shot_id, frame, hitter_side, coalesce(lead(frame) OVER (PARTITION BY clip_id ORDER BY frame, shot_id), 1000000000) AS nxt, frame + 360 AS lim FROM fx_shots),
    sx AS (SELECT s.*, d.frame AS df, b.frame AS bf, b.x, b.y, l.frame AS lf FROM sh s ASOF LEFT JOIN dd d ON d.clip_id = s.clip_id AND s.frame < d.frame ASOF LEFT JOIN bp b ON b.clip_id = s.clip_id AND s.frame < b.frame ASOF LEFT JOIN sm l ON l.clip_id = s.clip_id AND s.lim >= l.frame),
    en AS (SELECT *, CASE WHEN coalesce(df + 30 <= lf AND df < nxt + 30, false) THEN 'net' WHEN bf <= lim AND NOT (x BETWEEN -1 AND 21 AND y BETWEEN -1 AND 45) THEN 'out' WHEN bf <= lim AND nxt - bf >= 120 THEN 'not-returned' END AS reason FROM sx),
    ee AS (SELECT clip_id, CASE WHEN reason = 'net' THEN df ELSE bf END AS frame, reason, shot_id AS by_shot, hitter_side FROM en WHERE reason IS NOT NULL),
    sv AS (SELECT e.*, v.frame AS serve FROM ee e ASOF LEFT JOIN (SELECT clip_id, frame FROM fx_shots WHERE is_serve) v ON v.clip_id = e.clip_id AND e.frame >= v.frame),
    cr AS (SELECT sv.clip_id, sv.frame, sv.reason, sv.by_shot, any_value(sv.hitter_side) AS hitter_side FROM sv LEFT JOIN fx_shots q ON q.clip_id = sv.clip_id AND q.frame BETWEEN serve AND sv.frame GROUP BY sv.clip_id, sv.frame, sv.reason, sv.by_shot, serve HAVING sv.reason = 'net' OR serve IS NULL OR count(DISTINCT q.hitter_side) = 2),
    fr AS (SELECT * FROM cr QUALIFY row_number() OVER (PARTITION BY clip_id, frame ORDER BY by_shot) = 1), pt AS (SELECT f.clip_id, f.frame, n.frame AS next FROM fr f ASOF LEFT JOIN fr n ON n.clip_id = f.clip_id AND f.frame + 120 <= n.frame),
    kp(clip_id, frame, next) AS (SELECT clip_id, frame, next FROM pt WHERE (clip_id, frame) IN (SELECT (clip_id, min(frame)) FROM fr GROUP BY clip_id) UNION ALL SELECT pt.* FROM kp JOIN pt ON pt.clip_id = kp.clip_id AND pt.frame = kp.next)
    SELECT fr.clip_id, fr.frame, reason, by_shot, hitter_side FROM fr JOIN kp ON kp.clip_id = fr.clip_id AND kp.frame = fr.frame""")

    # ---- many clips, views
    add("a3_project_poses", lambda get: S.project_poses(get("poses"), get("court")).select("clip_id", "frame", "track_id", F.round("front_x", 6).alias("front_x"), F.round("front_y", 6).alias("front_y")), "p AS (SELECT clip_id, frame, track_id, " + ", ".join(
        f"CASE WHEN {a}v >= 0.3 THEN (h{i}0*{a}x + h{i}1*{a}y + h{i}2) / (h20*{a}x + h21*{a}y + h22) END AS {a}{c}c" for a in ("la", "ra") for i, c in enumerate("xy")) + """ FROM fx_poses JOIN fx_court USING (clip_id)),
    q AS (SELECT *, CASE WHEN layc IS NULL THEN rayc IS NOT NULL ELSE coalesce(abs(rayc - 22) < abs(layc - 22), false) END AS r FROM p)
    SELECT clip_id, frame, track_id, round(CASE WHEN r THEN raxc ELSE laxc END, 6) AS front_x, round(CASE WHEN r THEN rayc ELSE layc END, 6) AS front_y FROM q""")
    from ..operators import metrics as M
    names = {"shots": "true", "serve": "shot_type = 'serve'", "drive": "shot_type = 'drive'", "dink": "shot_type = 'dink'", "drop": "shot_type = 'drop'", "lob": "shot_type = 'lob'", "volleys": "is_volley", "forehands": "stroke_side = 'forehand'"}
    add("v5_category_counts", lambda get: S.category_counts(M.shot_mix(get("shots"), get("roles"))), "s AS (SELECT s.*, role FROM fx_shots s JOIN fx_roles r ON r.clip_id = s.clip_id AND r.track_id = s.track_id) " + " UNION ALL ".join(
        f"SELECT clip_id, '{k}' AS category, count_if({t}) AS match, count_if(role = 'user' AND {t}) AS \"user\", count_if(role = 'user' AND {t}) / nullif(count_if({t}), 0) AS user_share FROM s GROUP BY clip_id" for k, t in names.items()))
