"""URL filter: host and path rules first, then a character language-model ratio.

Rules judge the urls they fit; the longest rule wins. Two smoothed variable-order Markov models of characters, one of
the urls that rules allow and one of those they block, judge the rest: each character's probability is interpolated
from order 0 to ``ORDER`` (Witten-Bell: a context is trusted by how often and with how many different successors it
was seen). A url's score is the difference of its log-likelihoods divided by its length; the cutoff is calibrated on
a held-out fifth of the ruled urls, so that blocked and allowed ones are mistaken equally seldom in sum.

Counts are exact and kept as Spark tables that grow with the urls: occurrences of each (context, next character) and
the true number of different successors of each context, per class. What a character adds to a score depends on the
five characters that end with it only, so each different 5-gram is valued once, order by order, and a url's score is the
sum over its 5-grams. The cutoff comes from models without the held-out urls; verdicts from models of all ruled urls.

Defined results: null urls and urls without ``://`` have an empty host and path, fit no rule and are judged by the
model as empty text (score 0, allowed unless the cutoff is above 0); without ruled urls of both kinds everything is
allowed; repeated rows are judged each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, numbered, table

#: (verdict, host, path): fixed values of the contract.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
ORDER, HELD_OUT = 4, 5
#: Scores are calibrated on a grid of so many steps per unit, from -SPAN to SPAN.
STEPS, SPAN = 100, 5
#: Valued 5-grams up to this many are broadcast; more are joined with so many salts, since some are in every url.
BROADCAST_ROWS, SALTS = 200_000, 16


def host_and_path(url: Column) -> tuple[Column, Column]:
    """(host, path), both empty for null urls and urls without ``://``."""
    at = F.instr(url, "://")
    rest = F.regexp_extract(F.substr(url, at + 3), r"^([^/?#]*)([^?#]*)", 1)
    path = F.regexp_extract(F.substr(url, at + 3), r"^([^/?#]*)([^?#]*)", 2)
    some = F.coalesce(at > 0, F.lit(False))
    return F.when(some, ascii_lower(rest)).otherwise(""), F.when(some, path).otherwise("")


def ruled(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, url, host, path, rule (null if none fits) and rule_verdict."""
    host, path = host_and_path(F.col("url").cast("string"))
    placed = pages.select("page_id", F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"))
    pick, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # later ones are longer and win
        fits = ((F.col("host") == h) | F.endswith("host", F.lit("." + h))) & F.startswith("path", F.lit(p))
        pick, verdict = F.when(fits, h + p).otherwise(pick), F.when(fits, kind).otherwise(verdict)
    return placed.withColumn("rule", pick).withColumn("rule_verdict", verdict)


MODELS = [f"{c}_{part}" for part in ("part", "all") for c in ("block", "allow")]


def url_grams(rows: DataFrame) -> DataFrame:
    """(row_, gram, n, ...) of the ORDER + 1 characters that end with each character of ``rows(row_, url, ...)``."""
    padded = F.concat(F.lit("\n" * ORDER), F.col("url"))
    grams = F.transform(F.sequence(F.lit(1), F.length("url")), lambda i: F.substring(padded, i, F.lit(ORDER + 1)))
    return rows.filter(F.length("url") > 0).select("*", F.explode(grams).alias("gram")).groupBy(*[c for c in rows.columns if c != "url"], "gram").agg(F.count("*").alias("n"))


def gram_values(grams: DataFrame) -> DataFrame:
    """(gram, part, all): log-likelihood ratio of each gram's last character, by the models of part and of all ruled urls.

    ``grams(gram, n, label, held_out)``: label and held_out are null for urls without a rule."""
    of = {"block_part": "label = 0 and not held_out", "allow_part": "label = 1 and not held_out", "block_all": "label = 0", "allow_all": "label = 1"}
    longest = materialize(grams.groupBy("gram").agg(*[F.coalesce(F.sum(F.when(F.expr(of[m]), F.col("n"))), F.lit(0).cast("long")).alias(m) for m in MODELS]))
    last = None
    for k in range(ORDER + 1):
        counts = materialize(longest.groupBy(F.substring("gram", ORDER + 1 - k, k + 1).alias("g")).agg(*[F.sum(m).alias(m) for m in MODELS]))
        seen = counts.groupBy(F.substring("g", 1, k).alias("context")).agg(
            *[F.sum(m).alias(f"{m}_c") for m in MODELS], *[F.count_if(F.col(m) > 0).alias(f"{m}_kinds") for m in MODELS], F.count("*").alias("kinds_"))
        if k:
            lower = last.select(F.col("g").alias("tail"), *[F.col(f"{m}_p").alias(f"{m}_q") for m in MODELS])
            wide = (counts.withColumn("context", F.substring("g", 1, k)).withColumn("tail", F.substring("g", 2, k))
                    .join(seen, "context").join(lower, "tail"))
        else:
            wide = counts.join(F.broadcast(seen)).withColumns({f"{m}_q": 1 / (F.col("kinds_") + 1) for m in MODELS})  # one row
        # Witten-Bell: c / (c + kinds) * n / c + kinds / (c + kinds) * q
        last = materialize(wide.select("g", *[F.when(F.col(f"{m}_c") > 0, (F.col(m) + F.col(f"{m}_kinds") * F.col(f"{m}_q")) / (F.col(f"{m}_c") + F.col(f"{m}_kinds")))
                                              .otherwise(F.col(f"{m}_q")).alias(f"{m}_p") for m in MODELS]))
    return materialize(last.select(F.col("g").alias("gram"), *[(F.log(f"allow_{part}_p") - F.log(f"block_{part}_p")).alias(part) for part in ("part", "all")]))


def scores(known: DataFrame) -> DataFrame:
    """(row_, part_score, score) of ``known(row_, url, label, held_out)``: the ratio per character, 0 of empty urls."""
    grams = materialize(url_grams(known.select("row_", "url", "label", "held_out")))
    values = gram_values(grams)
    if values.count() <= BROADCAST_ROWS:
        valued = grams.join(F.broadcast(values), "gram")
    else:
        salted = values.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        valued = grams.withColumn("salt", F.pmod(F.xxhash64("row_"), F.lit(SALTS)).cast("int")).join(salted, ["gram", "salt"])
    # Sums of whole billionths don't depend on their order.
    total = lambda c: F.sum(F.round(F.col(c) * 1e9).cast("long") * F.col("n")) / 1e9 / F.sum("n")
    return materialize(valued.groupBy("row_").agg(total("part").alias("part_score"), total("all").alias("score")))


def judge_urls(spark: SparkSession, pages: DataFrame, rules=RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, score."""
    label = (F.col("rule_verdict") == "allow").cast("int")
    held_out = F.when(F.col("rule").isNotNull(), F.pmod(F.xxhash64("url"), F.lit(HELD_OUT)) == 0)
    known = numbered(ruled(pages, rules).withColumn("label", label).withColumn("held_out", held_out))
    zero = [F.coalesce(c, F.lit(0.0)).alias(c) for c in ("part_score", "score")]
    judged = materialize(known.join(scores(known), "row_", "left").select("page_id", "host", "path", "rule", "rule_verdict", "label", "held_out", *zero))
    edge = SPAN * STEPS
    held = (judged.filter("held_out").groupBy("label", F.greatest(F.lit(-edge), F.least(F.lit(edge), F.floor(F.col("part_score") * STEPS))).alias("bin"))
            .count().toPandas())  # 2 x 1001 rows at most
    cutoff = -np.inf
    if held["label"].nunique() == 2:
        share = np.zeros((2, 2 * edge + 2))
        np.add.at(share, (held["label"].to_numpy(int), held["bin"].to_numpy(int) + edge + 1), held["count"].to_numpy(float))
        below = np.cumsum(share / share.sum(axis=1, keepdims=True), axis=1)  # share of each class that a cutoff after this bin blocks
        wrong = below[1] + 1 - below[0]
        best = np.flatnonzero(wrong <= wrong.min() + 1e-12)
        cutoff = (best[len(best) // 2] - edge) / STEPS
    verdict = F.when(F.col("score") >= float(cutoff), "allow").otherwise("block") if np.isfinite(cutoff) else F.lit("allow")
    return judged.select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", verdict).alias("verdict"), "score")


def op8(spark, sf_dir: str) -> DataFrame:
    return judge_urls(spark, table(spark, sf_dir, "pages"))
