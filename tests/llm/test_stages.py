"""Brute-force versions of the pipeline's stages on small fixtures."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from rallyspark.llm import exact_dedup, mixing, near_copies, packing, quality, url_filter
from rallyspark.llm.common import numbered

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").lower())
    return {" ".join(w[i: i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    """Indexes of the rows that stay of (doc_id, text): the least id of each group, null ids last."""
    sets, comp = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                old, new = comp[i], comp[j]
                comp = [new if c == old else c for c in comp]
    best = {}
    for i, c in enumerate(comp):
        best[c] = min(best.get(c, (True, 0, len(rows))), (rows[i][0] is None, rows[i][0] or 0, i))
    return {b[2] for b in best.values()}


def copies(seed):
    rng, rows = random.Random(seed), []
    for n in (30, 100, 300, 1000):
        for changed in (0, 1, n // 100, n // 60, n // 30, n // 20, n // 8):
            base = [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
            other = list(base)
            for at in rng.sample(range(n), changed):
                other[at] = "changed"
            rows += [" ".join(base), " ".join(other)]
    walk = [f"v{i}" for i in range(200)]  # neighbours are similar, the ends are not
    for i in range(20):
        walk[10 * i: 10 * i + 4] = [f"x{i}a", f"x{i}b", f"x{i}c", f"x{i}d"]
        rows.append(" ".join(walk))
    rng.shuffle(rows)
    return rows


def test_near_copies_match_brute_force(spark):
    texts = copies(1)
    rows = list(enumerate(texts)) + [(900, None), (901, ""), (902, " \n"), (903, "one two"), (904, "One  two"), (905, "one three")]
    got = near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string"))
    kept = {r.doc_id for r in got.collect()}
    assert got.columns == ["doc_id", "text"] and kept == {rows[i][0] for i in brute_kept(rows)}
    assert len(kept) < len(rows) - 30
    assert near_copies.drop_near_copies(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_recall_of_planted_copies(spark):
    """Copies with similarities from 0.8 to 0.9, few words changed at random places: at least 0.99 are found; texts that share
    half of their words with a template are left alone and don't make one cluster."""
    rng, rows, pairs = random.Random(21), [], 0
    for k in range(500):
        n = rng.choice([40, 120, 400])
        base = [f"k{k}w{rng.randrange(10 ** 6)}" for _ in range(n)]
        other = list(base)
        while True:
            trial = list(other)
            trial[rng.randrange(n)] = f"c{rng.randrange(10 ** 6)}"
            a, b = shingles(" ".join(base)), shingles(" ".join(trial))
            if 5 * len(a & b) < 4 * len(a | b):
                break
            other = trial
        pairs += other != base
        rows += [" ".join(base), " ".join(other)]
    template = [f"t{i}" for i in range(60)]
    alone = len(rows)
    rows += [" ".join(template + [f"m{k}x{i}" for i in range(80)]) for k in range(800)]
    kept = {r.doc_id for r in near_copies.drop_near_copies(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    assert sum(i in kept and i + 1 in kept for i in range(0, alone, 2)) <= 0.01 * pairs + (alone // 2 - pairs)
    assert all(i in kept for i in range(0, alone, 2)) and all(i in kept for i in range(alone, len(rows)))
    # Pairs of the templates have a similarity of 0.26; before they are compared, few of them meet.
    docs = numbered(spark.createDataFrame([(r,) for r in rows[alone:]], "text string"))
    keys = near_copies._per_text(docs, lambda texts: list(near_copies.band_keys([near_copies.shingle_set(t) for t in texts])), "keys")
    assert keys.select(F.explode("keys").alias("k")).groupBy("k").count().agg(F.max("count")).first()[0] < 80


def test_large_clusters_are_compared_in_parts(spark, monkeypatch):
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    texts = []
    for _ in range(90):  # copies of one text, each with up to 12 changed words: neighbours by chains, many pairs too far apart
        words = list(base)
        for at in rng.sample(range(120), rng.randrange(13)):
            words[at] = f"c{rng.randrange(10 ** 6)}"
        texts.append(" ".join(words))
    rows = list(enumerate(texts + copies(3)))
    want = {rows[i][0] for i in brute_kept(rows)}
    for docs, shingles_ in ((2048, 2_000_000), (7, 2_000_000), (2048, 500)):
        monkeypatch.setattr(near_copies, "TILE_DOCS", docs)
        monkeypatch.setattr(near_copies, "TILE_SHINGLES", shingles_)
        assert {r.doc_id for r in near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == want


def test_near_copies_with_null_and_repeated_ids(spark):
    rng = random.Random(4)
    texts = copies(2)
    rows = [(None if i % 3 == 0 else rng.randrange(20), t) for i, t in enumerate(texts)]
    want = brute_kept(rows)
    got = [r.text for r in near_copies.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()]
    assert sorted(got) == sorted(rows[i][1] for i in want)


def test_mix_keeps_rows_of_null_and_repeated_ids(spark):
    rng = random.Random(8)
    rows = [(None if i % 3 == 0 else i % 50 if i % 3 == 1 else 1000 + i, f"t{i} " + "w " * rng.choice([0, 3, 40]) if i % 7 else " ", rng.choice(["a", "a", "b", None])) for i in range(900)]
    docs = numbered(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    plan = mixing.mix(docs, shards=3, block_docs=8, row=F.col("row_")).collect()
    text = {r.row_: r.text for r in docs.collect()}
    assert len(plan) == len({r.row_ for r in plan}) == len(rows)
    want = sorted((str(r.doc_id), str(r.source), " ".join(text[r.row_].split()[: d.words])) for r in plan for d in r.draws)
    got = sorted((str(r.doc_id), str(r.source), " ".join(r.text.split())) for r in mixing.mixed(docs.drop("row_"), shards=3, block_docs=8).collect())
    assert got == want
    assert {w for _, s, w in want if s == "b"} >= {" ".join(t.split()) for _, t, s in rows if s == "b" and t.split()}  # "b" is drawn in full


def test_null_ids_are_dealt_over_the_blocks(spark):
    rows = [(None, f"text {i}", "a") for i in range(2000)]
    assert mixing.sized(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("r").distinct().count() == 2000


def brute_scores(urls, labels):
    """Witten-Bell scores by dictionaries of exact counts."""
    order, count, successors = url_filter.ORDER, Counter(), defaultdict(set)
    alphabet = {c for u in urls for c in u or ""}
    for u, y in zip(urls, labels):
        for i, c in enumerate(u or ""):
            for k in range(order + 1):
                context = ("\n" * order + u)[i + order - k: i + order]
                if y is not None:
                    count[y, k, context] += 1
                    count[y, k, context, c] += 1
                    successors[y, k, context].add(c)
    out = []
    for u in urls:
        total = 0.0
        for i, c in enumerate(u or ""):
            for y, sign in ((1, 1), (0, -1)):
                p = 1 / (len(alphabet) + 1)
                for k in range(order + 1):
                    context = ("\n" * order + u)[i + order - k: i + order]
                    if n := count[y, k, context]:
                        kinds = len(successors[y, k, context])
                        p = (count[y, k, context, c] + kinds * p) / (n + kinds)
                total += sign * math.log(p)
        out.append(total / max(1, len(u or "")))
    return out


def test_equal_rows_are_dealt_over_the_blocks(spark, monkeypatch):
    """20,000 rows that are equal in everything: stretches of 100 are numbered, no block takes more than a few, none is lost."""
    monkeypatch.setattr(mixing, "RUN", 100)
    docs = spark.range(0, 20_000, 1, 4).selectExpr("CAST(NULL AS BIGINT) doc_id", "'five words are in here' text", "'s' source", "5 n_chars").unionByName(
        spark.range(500).selectExpr("id doc_id", "concat('one of ', id) text", "if(id % 2 = 0, 't', NULL) source", "9 n_chars"))
    sizes = mixing.sized(docs)
    hot = sizes.filter("doc_id IS NULL")
    assert sorted(r.copy for r in hot.select("copy").collect()) == list(range(1, 20_001))
    assert hot.groupBy(F.pmod("r", F.lit(313))).count().agg({"count": "max"}).first()[0] < 130
    assert sizes.filter("doc_id IS NOT NULL AND copy <> 1").isEmpty()
    mixed = mixing.mixed(docs, shards=4).groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("words"), F.count("*").alias("n"))
    got = {r.source: (r.words, r.n) for r in mixed.collect()}
    assert got["t"][0] == got[None][0] == 1500 and abs(got["s"][0] - 149_250) < 10 and 29_850 <= got["s"][1] <= 29_860  # 250 rows twice, 20,000 rows 1.4925 times


def test_url_scores_match_exact_counts_of_all_ruled_urls(spark, monkeypatch):
    rng = random.Random(12)
    urls = [f"http://{''.join(rng.choices('abcdé', k=6))}.{rng.choice(['com', 'net', 'org'])}/{rng.choice(['es', 'en', 'x'])}/{rng.randrange(50)}" for _ in range(150)] + [None, ""]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    label = {r.page_id: {"allow": 1, "block": 0}.get(r.rule_verdict) for r in url_filter.ruled(pages).collect()}
    assert set(label.values()) == {0, 1, None}
    want = brute_scores(urls, [label[i] for i in range(len(urls))])
    for most in (200_000, 0):  # broadcast and salted
        monkeypatch.setattr(url_filter, "BROADCAST_ROWS", most)
        got = {r.page_id: r.score for r in url_filter.judge_urls(spark, pages).collect()}
        assert len(got) == len(urls) and all(abs(got[i] - w) < 1e-6 for i, w in enumerate(want))


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, row_ string, doc_ int, gone_id long, of string, digest string, batch int, root long, size string, kept int, base_failed string, r_symbols int, n_words int, one int, stratum string, draw string, draws int, exact_digest_ int, i int, block int"


@pytest.fixture(scope="module")
def clashing(spark):
    rows = [(1, "a b c"), (1, "a b c"), (2, "A B C"), (3, None), (4, ""), (5, " \n\t "), (None, "a b c"), (None, None), (6, "word " * 3000)]
    rows += [(10 + i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(6)] + [(90, " ".join(f"w0x{j}" for j in range(60)) + " more"), (11, " ".join(f"w1x{j}" for j in range(60)))]
    fill = ["x", 1, 2, "o", "d", 3, 4, "s", 5, "b", 6, 7, 8, "t", "w", 9, 10, 11, 12]
    return spark.createDataFrame([(i, t, [None, "en"][k % 2], [None, "s", "t"][k % 3], None, *fill) for k, (i, t) in enumerate(rows)], CLASHING)


def test_stages_take_columns_of_any_name(spark, clashing):
    labels = spark.createDataFrame([(10, 1, 0), (10, 0, 0), (None, 1, 0), (11, None, None)], "doc_id long, quality int, toxic int")
    rows = [tuple(r) for r in clashing.collect()]
    text = lambda r: (r[1] or "").lower()
    for stage, want in (
            (lambda d: quality.keep_good(d, labels), [r for r in rows if len(text(r).split()) >= 20 and not text(r).startswith("word")]),
            (exact_dedup.drop_exact_duplicates, None), (near_copies.drop_near_copies, None), (lambda d: mixing.mixed(d, shards=2), None)):
        got = stage(clashing)
        assert got.columns == clashing.columns and [f.dataType for f in got.schema] == [f.dataType for f in clashing.schema]
        got = [tuple(r) for r in got.collect()]
        assert {r[5:] for r in got} == {rows[0][5:]}
        if want is not None:
            assert sorted(map(str, got)) == sorted(map(str, want))
        assert stage(clashing.filter("false")).count() == 0
    kept = [tuple(r) for r in exact_dedup.drop_exact_duplicates(clashing).collect()]
    assert sorted((text(r), r[0] or -1) for r in kept) == sorted({t: max(r[0] or -1 for r in rows if text(r) == t) for t in map(text, rows)}.items())


def test_quality_cutoffs_bind_and_match_sql(spark):
    """A table on which rules reject: Spark and DuckDB agree, and few labelled good documents are rejected."""
    import duckdb
    import pandas as pd

    rng = random.Random(21)
    rows, labels = [], []
    for i in range(4200):
        bad = i % 3 == 0
        words = [f"w{rng.randrange(900)}" for _ in range(rng.randint(25, 40))]
        if bad:
            words += ["#$%" * rng.randint(1, 4), "!" * rng.randint(3, 9)] * rng.randint(1, 3)
        elif rng.random() < 0.01:
            words.append("!")
        rows.append((i, " ".join(words), "en" if i % 20 else [None, "fr"][i % 40 // 20], "s", 0))
        if i % 10 != 9:
            labels.append((i, int(not bad) if rng.random() < 0.97 else int(bad), 0))
            if i % 50 == 0:
                labels.append(labels[-1])  # one trial, not two
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.kept for r in quality.judge(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]))
    con.register("labels", pd.DataFrame(labels, columns=["doc_id", "quality", "toxic"]))
    assert got == {r[0]: r[1] for r in con.execute(f"SELECT doc_id, kept FROM ({quality.SQL})").fetchall()}
    good = [i for i, y, _ in set(labels) if y and i % 20]
    rejected = [i for i in good if not got[i]]
    assert len(rejected) <= quality.ALPHA * len(good) and sum(not got[i] for i in range(0, 4200, 3) if i % 20) > 600
    assert all(got[i] for i in range(0, 4200, 20))  # too few labels for the bound: nothing is rejected


def test_best_fit_against_the_best_packing_of_tiny_cases():
    """All ways to pack up to seven pieces into bins: best-fit stays within a third of the least cost, and is valid."""
    def parts(items):
        if not items:
            yield []
            return
        for rest in parts(items[1:]):
            yield [[items[0]], *rest]
            for k in range(len(rest)):
                yield [*rest[:k], [items[0], *rest[k]], *rest[k + 1:]]

    rng, caps = random.Random(4), (8, 16, 32)
    gaps = []
    for _ in range(60):
        sizes = [rng.randint(1, 32) for _ in range(rng.randint(1, 7))]
        where, final = packing.best_fit(sizes, caps, 1.0, 64.0)
        used = Counter()
        for b, n in zip(where, sizes):
            used[b] += n
        assert all(used[b] <= final[b] for b in used) and all(final[b] == min(c for c in caps if c >= used[b]) for b in used)
        cost = lambda bins: sum(packing.bin_cost(min(c for c in caps if c >= sum(b)), 1.0, 64.0) for b in bins)
        best = min(cost(p) for p in parts(sizes) if all(sum(b) <= 32 for b in p))
        gaps.append(sum(packing.bin_cost(c, 1.0, 64.0) for c in final) / best)
    assert max(gaps) <= 4 / 3 and sum(gaps) / len(gaps) < 1.05


def test_pipeline_rows_match_brute_force(spark, monkeypatch):
    """Rules, exact copies, near copies and the mix's words, each in plain Python, on a small table."""
    import corpus_pipeline

    rng = random.Random(17)
    rows = []
    for i in range(90):
        words = [f"v{rng.randrange(5000)}" for _ in range(rng.choice([5, 40, 80]))]
        rows.append([i, " ".join(words), "en", rng.choice(["a", "b", None]), 0])
    for k in range(15):
        rows.append([100 + k, rows[k * 3][1].upper(), "en", "a", 0])  # copies but for case
        near = rows[k * 3 + 1][1].split()
        rows.append([200 + k, " ".join([*near, "tail"]), "en", "b", 0])
        rows.append([300 + k, " ".join(["same words again and again here now then"] * 9), "en", "b", 0])  # repeats
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(corpus_pipeline, "table", lambda spark_, sf, name: labels if name == "labels" else docs)

    def repeated(w):
        seen = Counter(tuple(w[i: i + 8]) for i in range(len(w) - 7))
        return len({j for i in range(len(w) - 7) if seen[tuple(w[i: i + 8])] > 1 for j in range(i, i + 8)})

    kept = [r for r in rows if len(w := WORD.findall(r[1])) >= 20 and 100 * repeated(w) <= 30 * len(w)]
    last = {}
    for r in kept:
        last[r[1].lower()] = max(last.get(r[1].lower(), r), r)
    kept = sorted(r for r in kept if last[r[1].lower()] is r)
    near = brute_kept([(r[0], r[1]) for r in kept])
    kept = [r for i, r in enumerate(kept) if i in near]
    out = docs
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, out, "")
    assert sorted(r.doc_id for r in out.collect()) == [r[0] for r in kept] and len(kept) < 75
    mix = corpus_pipeline.STAGES[3][1](spark, out, "").collect()
    text = {r[0]: r[1] for r in kept}
    assert {r.doc_id for r in mix} <= set(text) and all(text[r.doc_id].startswith(r.text) and r.n_chars == len(r.text) for r in mix)
    assert max(Counter(r.doc_id for r in mix).values()) <= 2
    assert abs(sum(len(r.text.split()) for r in mix) - 1.5 * sum(len(t.split()) for t in text.values())) <= 3
    packed = corpus_pipeline.STAGES[4][1](spark, corpus_pipeline.STAGES[3][1](spark, out, ""), "").collect()
    assert sum(r.n_tokens for r in packed) == sum(len(r.text.split()) + 1 for r in mix)
    by_bin = defaultdict(int)
    for r in packed:
        by_bin[r.bin_id] += r.n_tokens
    assert all(by_bin[r.bin_id] == r.bin_used <= r.capacity for r in packed)
