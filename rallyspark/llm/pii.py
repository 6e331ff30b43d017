"""Personal data by weak supervision, in DataFrame functions only.

Base spans (email, ip, card, phone) come from fixed patterns and always stay. Beside them, every word with a digit is a
candidate. Labelers vote on candidates: patterns (base shapes, long digit runs, version numbers), gazetteers (words
that name secrets, words that number things) and context (what stands before). Expectation-maximisation over the
counts of vote patterns (3 ** 6 at most, however large the corpus) estimates how reliable each labeler is and a
probability per pattern. Those probabilities are the soft labels on which the final span classifier, a naive Bayes model
over the candidate's shape and context, is trained; candidates that it accepts and that touch no base span are
added as kind ``secret``. The model is one row.

Defined results: null text counts as empty; repeated rows are judged each; without candidates nothing is added; an
empty table gives an empty result; extra columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, materialize, table

KINDS = ("email", "ip", "card", "phone", "secret")
_SPACE = r"\x20\x09-\x0D"
#: The contract's patterns. Quantifiers are possessive and matches start at the head of a run (or where the last match
#: ended): neither changes what matches, and both keep long runs linear.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
WORD = rf"(?<![^{_SPACE}])[^{_SPACE}0-9]*+[0-9][^{_SPACE}]*+"
LABELERS = 6
#: What the gazetteers hold.
NAMES_SECRET = "password|passwd|pwd|token|secret|apikey|api_key|key|bearer|akia|login|ssn|iban|phone|tel|mobile|card|account"
NAMES_NUMBER = "version|license|licence|cc|by|nc|sa|chapter|section|page|pages|figure|table|volume|vol|no|part|step|item"
ROUNDS = 15


def located(text: Column, pattern: str, before: int = 0) -> Column:
    """Array of (start, end, word[, before]) of all matches: the pieces between matches give the offsets.

    The running sum of lengths is made by doubling (log k passes), so a text with very many matches stays cheap.
    """
    def walk(m: Column, pieces: Column) -> Column:
        steps = F.filter(F.array(*[F.lit(1 << d) for d in range(31)]), lambda d: d < F.size(m))
        ends = F.aggregate(steps, F.zip_with(m, F.slice(pieces, F.lit(1), F.size(m)), lambda x, y: F.length(x) + F.length(y)),
                           lambda a, d: F.transform(a, lambda x, i: x + F.coalesce(F.get(a, i - d), F.lit(0))))
        return let(ends, lambda e: F.transform(m, lambda w, i: F.struct(
            (F.get(e, i) - F.length(w)).alias("start"), F.get(e, i).alias("end"), w.alias("word"), (F.right(F.get(pieces, i), F.lit(before)) if before else F.lit("")).alias("before"))))

    empty = F.array().cast("array<struct<start:int,end:int,word:string,before:string>>")
    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda m: F.when(F.size(m) == 0, empty).otherwise(
        let(F.split(text, pattern, -1), lambda p: walk(m, p))))


def digits(word: Column) -> Column:
    return F.regexp_replace(word, "[^0-9]+", "")


def luhn(d: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    def add(s: Column, i: Column) -> Column:
        x = F.substr(d, F.length(d) - i, F.lit(1)).cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return s + F.when(x > 9, x - 9).otherwise(x)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), add) % 10 == 0


def small_part(part: Column) -> Column:
    """A run of digits with a value of at most 255, leading zeros or not."""
    p = F.regexp_replace(part, "^0+", "")
    return (F.length(p) <= 2) | ((F.length(p) == 3) & (p <= "255"))


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end, word) of the base spans; kind is an index into KINDS. Texts without the characters
    that a kind needs are not searched."""
    def of(kind: int, seen: Column, pattern: str, ok) -> Column:
        none = F.array().cast("array<struct<start:int,kind:int,end:int>>")
        good = F.filter(located(text, pattern), lambda s: ok(s["word"]))
        return F.when(seen, F.transform(good, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), s["end"].alias("end")))).otherwise(none)

    n = lambda w: F.length(digits(w))
    every = [of(0, F.contains(text, F.lit("@")), EMAIL, lambda w: F.lit(True)),
             of(1, text.rlike(r"[0-9]\.[0-9]"), IP, lambda w: F.forall(F.split(w, r"\."), small_part)),
             of(2, text.rlike(r"[0-9](?:[\x20-]?[0-9]){11}"), CARD, lambda w: F.when(n(w).between(12, 19), luhn(digits(w))).otherwise(False)),
             of(3, F.contains(text, F.lit("+")), PHONE, lambda w: n(w).between(9, 15))]
    return F.array_sort(F.concat(*every))


def candidates(text: Column) -> Column:
    """Array of (start, end, votes, traits) of the words with a digit; a vote is 0 (no), 1 (none) or 2 (yes)."""
    def judged(c: Column) -> Column:
        w, b = c["word"], F.lower(c["before"])
        n, n_digits = F.length(w), F.length(digits(w))
        named = b.rlike(rf"(?:^|[^a-z])(?:{NAMES_SECRET})[^a-z0-9]*$") | F.lower(w).rlike(rf"^[^a-z0-9]*(?:{NAMES_SECRET})[^a-z]")
        numbered = b.rlike(rf"(?:^|[^a-z])(?:{NAMES_NUMBER})[^a-z0-9]*$")
        votes = F.array(
            F.when(w.rlike(r"@[A-Za-z0-9-]+\.|^\+[0-9]|^[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), 2).otherwise(1),
            F.when((n_digits >= 6) & w.rlike("[A-Za-z@=]"), 2).when(n_digits <= 2, 0).otherwise(1),
            F.when(w.rlike(r"^[\"'(\[]*[0-9]++(?:[.,:/-][0-9]++)*+[.,;:!?)\]\"']*$"), 0).otherwise(1),
            F.when(named | w.rlike(r"AKIA[0-9A-Z]{12}"), 2).otherwise(1), F.when(numbered, 0).otherwise(1),
            F.when(n >= 12, 2).when(n <= 4, 0).otherwise(1))
        traits = F.array(
            F.concat(F.lit("length "), F.least(F.lit(6), F.floor(n / 4)).cast("string")), F.concat(F.lit("digits "), F.floor(4 * n_digits / n).cast("string")),
            F.when(w.rlike("[A-Z]") & w.rlike("[a-z]"), "case both").when(w.rlike("[A-Z]"), "case upper").when(w.rlike("[a-z]"), "case lower").otherwise("case none"),
            F.when(w.rlike("[=@_\"]"), "mark yes").otherwise("mark no"), F.when(named, "before secret").when(numbered, "before number").otherwise("before other"))
        end = c["end"] - n + F.length(F.rtrim(w, F.lit(".,;:!?)]'\"")))
        return F.struct(c["start"].alias("start"), end.alias("end"), votes.alias("votes"), traits.alias("traits"))

    none = F.array().cast("array<struct<start:int,end:int,votes:array<int>,traits:array<string>>>")
    return F.when(text.rlike("[0-9]"), F.transform(located(text, WORD, 24), judged)).otherwise(none)


def em(patterns: Column) -> Column:
    """Fits labeler reliabilities to an array of (votes, n): returns (prior, yes, no), the vote probabilities given either class."""
    cells = F.sequence(F.lit(0), F.lit(3 * LABELERS - 1))
    start = F.struct(F.lit(0.5).alias("prior"), F.array(*[F.lit(p) for _ in range(LABELERS) for p in (0.1, 0.4, 0.5)]).alias("yes"),
                     F.array(*[F.lit(p) for _ in range(LABELERS) for p in (0.5, 0.4, 0.1)]).alias("no"))

    def step(m: Column, _) -> Column:
        def refit(rows: Column) -> Column:
            yes, no = F.aggregate(rows, F.lit(0.0), lambda s, r: s + r["y"]), F.aggregate(rows, F.lit(0.0), lambda s, r: s + r["o"])

            def share(field: str):
                total = F.aggregate(rows, F.lit(0.0), lambda s, r: s + r[field])
                return let(total, lambda t: F.transform(cells, lambda c: (F.aggregate(rows, F.lit(1.0), lambda s, r: s + F.when(
                    F.get(r["v"], F.floor(c / 3).cast("int")) == c % 3, r[field]).otherwise(0.0))) / (t + 3.0)))

            return F.struct(((yes + 1) / (yes + no + 2)).alias("prior"), share("y").alias("yes"), share("o").alias("no"))

        rows = F.transform(patterns, lambda p: let(F.lit(1.0) / (1.0 + F.exp(-logit(m, p["votes"]))), lambda q: F.struct(
            p["votes"].alias("v"), (p["n"] * q).alias("y"), (p["n"] * (1.0 - q)).alias("o"))))
        return let(rows, refit)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step)


def logit(m: Column, votes: Column) -> Column:
    """Log odds that a candidate with these votes is personal."""
    prior = F.log(m["prior"] / (1.0 - m["prior"]))
    return F.aggregate(F.sequence(F.lit(0), F.lit(LABELERS - 1)), prior, lambda s, j: s + F.log(F.get(m["yes"], 3 * j + F.get(votes, j)) / F.get(m["no"], 3 * j + F.get(votes, j))))


def train(found: DataFrame) -> DataFrame:
    """The final classifier from ``found(cands)``: one row with its prior and a weight per trait (at most 40)."""
    votes = materialize(found.select(F.explode("cands").alias("c")).groupBy("c.votes", "c.traits").agg(F.count("*").cast("double").alias("n")))
    model = votes.groupBy("votes").agg(F.sum("n").alias("n")).groupBy().agg(F.sort_array(F.collect_list(F.struct("votes", "n"))).alias("p")).select(F.lit(1).alias("one"), em(F.col("p")).alias("m"))
    soft = votes.withColumn("one", F.lit(1)).join(F.broadcast(model), "one").withColumn("q", F.lit(1.0) / (1.0 + F.exp(-logit(F.col("m"), F.col("votes")))))
    # Totals stand beside the traits under an empty name: one pass gives both.
    sums = (soft.select(F.explode(F.concat("traits", F.array(F.lit("")))).alias("trait"), (F.col("n") * F.col("q")).alias("y"), (F.col("n") * (1.0 - F.col("q"))).alias("o"))
            .groupBy("trait").agg(F.sum("y").alias("y"), F.sum("o").alias("o")))
    total = F.max(F.when(F.col("trait") == "", F.struct("y", "o")))
    return materialize(sums.groupBy().agg(total.alias("t"), F.collect_list(F.struct("trait", "y", "o")).alias("rows")).select(
        F.lit(1).alias("one"), F.log((F.col("t.y") + 1.0) / (F.col("t.o") + 1.0)).alias("prior"),
        F.map_from_entries(F.transform("rows", lambda r: F.struct(r["trait"], F.log(((r["y"] + 0.5) / (F.col("t.y") + 5.0)) / ((r["o"] + 0.5) / (F.col("t.o") + 5.0)))))).alias("weights")))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in KINDS]), s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = materialize(docs.select("doc_id", base_spans(text).alias("base"), candidates(text).alias("cands")))
    judged = found.withColumn("one", F.lit(1)).join(F.broadcast(train(found)), "one", "left")

    def accept(c: Column) -> Column:
        score = F.aggregate(c["traits"], F.col("prior"), lambda s, t: s + F.coalesce(F.element_at("weights", t), F.lit(0.0)))
        return (score > 0) & (c["end"] > c["start"]) & ~F.exists("base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))

    added = F.transform(F.filter("cands", accept), lambda c: F.struct(c["start"].alias("start"), F.lit(4).alias("kind"), c["end"].alias("end")))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return judged.withColumn("added", F.when(F.size("cands") > 0, added).otherwise(F.array().cast("array<struct<start:int,kind:int,end:int>>"))).select(
        "doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:4])], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        joined(F.array_sort(F.concat("base", "added"))).alias("spans"), F.size("added").cast("long").alias("n_added"))


def op7(spark, sf_dir: str) -> DataFrame:
    return personal_data(table(spark, sf_dir, "documents"))
