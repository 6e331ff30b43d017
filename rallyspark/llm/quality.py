"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule is a count per thousand on the grid 0..1000 (more is worse). Per stratum (language) and rule, the labelled
good documents are a holdout: cutoffs are tested from the most lenient to the strictest, and the strictest one is
kept whose false rejections k of n pass the exact binomial test P(Bin(n, alpha_rule) <= k) <= delta_rule, which is
the same as a Clopper-Pearson upper bound of at most alpha_rule. Testing a nested sequence needs no correction over
cutoffs; delta is divided by rules x strata (Bonferroni) and alpha by rules, so that with probability 1 - delta
every stratum rejects at most ``alpha`` of its good documents. From there the cutoff is loosened while it still
catches ``power`` of the labelled bad documents that the strictest one catches. A rule that catches none, or a stratum
with too few labels for the bound, rejects nothing.

Defined results: null text has no words; each labelled language is a stratum, null too; languages without labels have
no cutoffs; labels with null fields are ignored, and of labels of one doc_id the worst counts, once; without labels only
the base rules act; repeated rows are judged each; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY, count_of, let, materialize, row_key, table, without, words

ALPHA, DELTA, POWER = 0.05, 0.05, 98
WINDOW = 8
RULES = ("symbols", "dup_lines", "repeats", "capitals", "bangs")


def repeated_words(w: Column) -> Column:
    """Words of ``w`` inside 8-word windows that occur at least twice (windows are compared by 64-bit hashes)."""
    def covered(keys: Column) -> Column:
        def starts(s: Column) -> Column:
            twice = F.filter(s, lambda x, j: (F.get(s, j - 1)["h"] == x["h"]) | F.coalesce(F.get(s, j + 1)["h"] == x["h"], F.lit(False)))
            return F.array_sort(F.transform(twice, lambda x: x["i"]))

        total = F.aggregate(
            let(F.sort_array(F.transform(keys, lambda h, i: F.struct(h.alias("h"), i.alias("i")))), starts),
            F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n")),
            lambda a, i: F.struct(i.alias("last"), (a["n"] + F.least(F.lit(WINDOW), i - a["last"])).alias("n")), lambda a: a["n"])
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.lit(0)).otherwise(total)

    def windows(h: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)]))

    hashes = F.transform(w, lambda x: F.xxhash64(x))
    return F.when(F.size(w) < WINDOW + 1, F.lit(0)).otherwise(let(let(hashes, windows), covered)).cast("long")


def base_features(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """doc_id, lang, the contract's counts, base_failed, the rule columns r_* on the grid 0..1000, and ``keep``'s columns of ``docs``."""
    keep = keep or []
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_words = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    counted = docs.select(
        *keep, "doc_id", F.col("lang").cast("string").alias("lang"), of_words.alias("w"), of_lines.alias("l"),
        (F.length(text) - count_of(text, r"\x20\x09-\x0D")).cast("long").alias("word_chars"), count_of(text, r"#*$%&|<>").alias("n_symbols"),
        count_of(text, "A-Z").alias("n_caps"), count_of(text, "!").alias("n_bangs")).select(
        *keep, "doc_id", "lang", "w.*", "l.*", "word_chars", "n_symbols", "n_caps", "n_bangs")
    grid = lambda a, b: F.least(F.lit(1000).cast("long"), F.expr(f"try_divide(1000 * {a} - 1000 * {a} % {b}, {b})").cast("long"))
    return counted.withColumn("base_failed", F.expr("n_words < 20 or 100 * n_repeat_words > 30 * n_words")).select(
        "*", *[F.coalesce(grid(a, f"nullif({b}, 0)"), F.lit(0).cast("long")).alias(f"r_{rule}") for rule, a, b in (
            ("symbols", "n_symbols", "n_words"), ("dup_lines", "n_dup_lines", "n_lines"), ("repeats", "n_repeat_words", "n_words"),
            ("capitals", "n_caps", "word_chars"), ("bangs", "n_bangs", "n_words"))])


def allowed_rejections(n: Column, alpha: float, log_delta: Column) -> Column:
    """Largest k with P(Bin(n, alpha) <= k) <= delta, or -1: the cumulative sum is folded in logarithms."""
    odds = math.log(alpha / (1 - alpha))

    def add(s: Column, j: Column) -> Column:
        term = s["term"] + F.log((n - j + 1) / j) + F.lit(odds)
        top = F.greatest(s["sum"], term)
        total = top + F.log1p(F.exp(F.least(s["sum"], term) - top))
        return F.struct(term.alias("term"), total.alias("sum"), (s["k"] + F.when(total <= log_delta, 1).otherwise(0)).alias("k"))

    zero = n * F.lit(math.log1p(-alpha))
    first = F.struct(zero.alias("term"), zero.alias("sum"), F.when(zero <= log_delta, 0).otherwise(-1).alias("k"))
    steps = F.sequence(F.lit(1).cast("long"), F.greatest(F.lit(1).cast("long"), F.ceil(n * F.lit(alpha)).cast("long")))
    return F.when(zero > log_delta, F.lit(-1)).otherwise(F.aggregate(steps, first, add, lambda s: s["k"]))


def stratum_of(lang: Column) -> Column:
    return F.coalesce(F.concat(F.lit("lang:"), lang), F.lit("null"))


def cutoffs(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, power: int = POWER) -> DataFrame:
    """A row per labelled language: stratum and a cutoff column c_<rule> per rule.

    All labels count; what leaves the cluster's partial sums is a histogram of at most 1001 bins per stratum and rule.
    Labelled documents are trials, so of repeated labels or repeated rows of one doc_id one trial is made.
    """
    once = labels.filter("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    marked = (features.filter("doc_id is not null").select("doc_id", "base_failed", F.struct("lang", *[f"r_{r}" for r in RULES]).alias("x")).join(once, "doc_id")
              .groupBy("doc_id", "quality").agg(F.max("base_failed").alias("base_failed"), F.max("x").alias("x")).filter("not base_failed").select("quality", "x.*"))
    bins = materialize(marked.select("lang", "quality", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"r_{r}").alias("bin")) for r in RULES])).alias("x"))
                       .groupBy("lang", "x.rule", "x.bin").agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad")))
    placed = bins.select(stratum_of(F.col("lang")).alias("stratum"), "rule", "bin", "good", "bad")
    whole = Window.partitionBy("stratum", "rule")
    above = whole.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    tests = F.lit(math.log(delta)) - F.log(F.lit(len(RULES)) * F.col("n_strata"))
    counted = placed.select(
        "*", F.coalesce(F.sum("good").over(above), F.lit(0)).alias("good_above"), F.coalesce(F.sum("bad").over(above), F.lit(0)).alias("bad_above"),
        F.sum("good").over(whole).alias("n"))
    n_strata = placed.agg(F.count_distinct("stratum").alias("n_strata")).withColumn("one", F.lit(1))
    bounded = counted.withColumn("one", F.lit(1)).join(F.broadcast(n_strata), "one").withColumn("k", allowed_rejections(F.col("n"), alpha / len(RULES), tests))
    safe = bounded.filter("good_above <= k")  # rejecting what lies above this bin is within the bound
    most = safe.withColumn("best", F.max("bad_above").over(whole)).filter(f"best > 0 and 100 * bad_above >= {power} * best")
    # between this bin and the next one that is in use no document lies: the cutoff may rise to just below it
    nxt = counted.select("stratum", "rule", "bin", F.lead("bin").over(whole.orderBy("bin")).alias("next"))
    chosen = (most.join(nxt, ["stratum", "rule", "bin"]).groupBy("stratum", "rule").agg(F.max(F.coalesce(F.col("next") - 1, F.col("bin"))).alias("cutoff")))
    wide = chosen.groupBy("stratum").pivot("rule", list(RULES)).agg(F.first("cutoff"))
    return wide.select("stratum", *[F.coalesce(F.col(r), F.lit(1000)).alias(f"c_{r}") for r in RULES])


def verdicts(features: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """``features`` (written) with kept."""
    cuts = materialize(cutoffs(features, labels, alpha, delta))
    passes = [F.col(f"r_{r}") <= F.coalesce(F.col(f"c_{r}"), F.lit(1000)) for r in RULES]
    ok = passes[0]
    for p in passes[1:]:
        ok = ok & p
    placed = features.withColumn("stratum", stratum_of(F.col("lang"))).join(cuts, "stratum", "left")
    return placed.withColumn("kept", ~F.col("base_failed") & ok).drop("stratum", *[f"c_{r}" for r in RULES])


def judge(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per document with its counts, base_failed and kept (other columns of base_features stay)."""
    return verdicts(materialize(base_features(docs)), labels, alpha, delta)


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def op5(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select("doc_id", *COUNTS, "base_failed", "kept")


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows, each judged by itself; all columns stay, whatever their names."""
    key = row_key(F.col("lang").cast("string"), F.col("text").cast("string"))  # all that a verdict depends on
    features = materialize(base_features(docs.select("doc_id", "lang", "text", *key), KEY))
    return without(docs, key, materialize(verdicts(features, labels).filter("not kept").select(*KEY).distinct()))


_W = "regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')"
SQL = f"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS text, {_W} AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS i, w FROM d),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, array_to_string(w[i:i+7], ' ')) AS c FROM g),
s AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS nx FROM h WHERE c > 1),
r AS (SELECT doc_id, sum(least(8, coalesce(nx - i, 8))) AS n_repeat_words FROM s GROUP BY doc_id),
b AS (SELECT d.doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(len(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) AS BIGINT) AS n_lines,
    CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    len(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_caps, len(regexp_replace(text, '[^!]', '', 'g')) AS n_bangs
    FROM d LEFT JOIN r ON d.doc_id = r.doc_id),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN least(1000, 1000 * n_symbols // n_words) ELSE 0 END AS r1, CASE WHEN n_lines > 0 THEN least(1000, 1000 * n_dup_lines // n_lines) ELSE 0 END AS r2,
    CASE WHEN n_words > 0 THEN least(1000, 1000 * n_repeat_words // n_words) ELSE 0 END AS r3, CASE WHEN word_chars > 0 THEN least(1000, 1000 * n_caps // word_chars) ELSE 0 END AS r4,
    CASE WHEN n_words > 0 THEN least(1000, 1000 * n_bangs // n_words) ELSE 0 END AS r5 FROM b),
ql AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1) GROUP BY doc_id),
m AS (SELECT coalesce('lang:' || lang, 'null') AS stratum, quality, unnest([1, 2, 3, 4, 5]) AS rule, unnest([r1, r2, r3, r4, r5]) AS bin
    FROM f JOIN ql USING (doc_id) WHERE NOT base_failed),
p AS (SELECT stratum, rule, bin, sum(quality) AS good, sum(1 - quality) AS bad FROM m GROUP BY ALL),
c AS (SELECT *, coalesce(sum(good) OVER a, 0) AS ga, coalesce(sum(bad) OVER a, 0) AS ba, sum(good) OVER (PARTITION BY stratum, rule) AS n,
    lead(bin) OVER (PARTITION BY stratum, rule ORDER BY bin) AS nx, (SELECT count(DISTINCT stratum) FROM p) AS ns
    FROM p WINDOW a AS (PARTITION BY stratum, rule ORDER BY bin DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
q AS (SELECT DISTINCT stratum, n, ns FROM c),
z AS (SELECT stratum, n, ns, unnest(range(0, CAST(ceil(n * {ALPHA / len(RULES)}) AS BIGINT) + 1)) AS j FROM q),
y AS (SELECT stratum, j, ns, sum(exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({ALPHA / len(RULES)}) + (n - j) * ln(1 - {ALPHA / len(RULES)}))) OVER (PARTITION BY stratum ORDER BY j) AS cdf FROM z),
k AS (SELECT stratum, count(*) FILTER (cdf <= {DELTA} / ({len(RULES)} * ns)) - 1 AS k FROM y GROUP BY stratum),
o AS (SELECT c.*, max(ba) OVER (PARTITION BY c.stratum, rule) AS best FROM c JOIN k ON c.stratum = k.stratum WHERE ga <= k),
u AS (SELECT stratum, rule, max(coalesce(nx - 1, bin)) AS cutoff FROM o WHERE best > 0 AND 100 * ba >= {POWER} * best GROUP BY stratum, rule)
SELECT f.doc_id, {', '.join(f'f.{x}' for x in COUNTS)}, f.base_failed,
    NOT f.base_failed AND NOT EXISTS (SELECT 1 FROM u WHERE u.stratum = coalesce('lang:' || f.lang, 'null') AND CASE rule WHEN 1 THEN r1 WHEN 2 THEN r2 WHEN 3 THEN r3 WHEN 4 THEN r4 ELSE r5 END > cutoff) AS kept
FROM f
"""
