"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions only.

1. Targets: each source's share by weight, stopped at ``max_epochs`` times its size, the excess reshared round by round
   until none is above.
2. Blocks: a source's documents are dealt by hash into blocks of about ``block_docs``; the hash makes the block
   numbers a random permutation of its blocks. A mix takes every block in full for each whole epoch of the target and
   then permuted blocks in order until the rest is reached; the last document is taken in part.
3. Shards: the number of blocks drawn from each source is split exactly over the output shards by a binary tree. A
   node splits its vector of block quotas in two by drawing the left half's vector from the multivariate
   hypergeometric distribution (source after source, each by inverse CDF; above ``GROUP`` sources first by groups of
   sources), so shards differ only as random draws without replacement do. A shard's quota of a source is a run of
   that source's permuted blocks: runs are disjoint.
4. Inside a shard, draws are ordered by a hash (``order_key``): mixed() writes each shard's rows together, in that order.

Rows that are equal in id, text and source are numbered (``copy``) and dealt over the blocks by their number too, so a
row that repeats a billion times is spread like any other rows. The numbering has two levels: inside a stretch of RUN
rows as they were read, and over the stretches of a key.

All draws are hashes of (seed, node, source), so reruns agree. Cumulative sums run over groups of blocks, blocks of a
group and documents of a block, so no window holds more than about ``FAN`` rows of a source however hot it is. Tables
of sources, blocks and runs are joined without hints: Spark broadcasts them while they are below its own threshold.

Defined results: null text has size 0; a null source is one source, ordered last; sizes of 0 take 0; repeated rows and
null doc_ids are documents of their own; empty tables give empty results; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import KEY, let, materialize, of_box, row_key, table, unboxed, words

WEIGHTS, TOTAL, MAX_EPOCHS = (5, 2, 1), 1.5, 2
BLOCK_DOCS, FAN, SEED = 64, 1024, 7
RUN = 4096  # rows of a stretch in which repeats are numbered
#: Words of a shard, fewest shards, sources split at once by a node, sources ranked by a task.
SHARD_WORDS, LEAST_SHARDS, GROUP, RANKED = 4_000_000, 16, 256, 100_000
SOURCE = ["source_", "no_source"]  # a null source has a name of its own


def named(source: Column) -> list[Column]:
    return [F.coalesce(source, F.lit("")).alias("source_"), source.isNull().alias("no_source")]


def copies(rows: DataFrame) -> DataFrame:
    """``rows(k1, k2, at_, ...)``, a written table, with ``copy`` (from 1) among the rows of its key instead of ``at_``.

    ``at_`` is monotonically_increasing_id() as it was written: no stretch of a key has more than RUN rows, and a key has a
    row per stretch in the window over stretches."""
    stretched = rows.withColumn("run_", F.expr(f"at_ div {RUN}"))
    over = Window.partitionBy(*KEY).orderBy("run_").rowsBetween(Window.unboundedPreceding, -1)
    before = stretched.groupBy(*KEY, "run_").agg(F.count("*").alias("n")).withColumn("before_", F.sum("n").over(over)).filter("before_ > 0").drop("n")
    inside = F.row_number().over(Window.partitionBy(*KEY, "run_").orderBy("at_"))
    return (stretched.withColumn("copy", inside).join(before, [*KEY, "run_"], "left")
            .withColumn("copy", F.col("copy") + F.coalesce("before_", F.lit(0).cast("long"))).drop("at_", "run_", "before_"))


def sized(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """(row_, doc_id, source, source_, no_source, size, copy, r) and row_key, written to the shared folder; ``r`` is the hash that
    permutes the documents. It takes the text and the number of the copy too, so that null and repeated ids and repeated
    rows are dealt over the blocks like any others."""
    at = F.monotonically_increasing_id()
    source = F.col("source").cast("string")
    read = materialize(docs.select(
        at.alias("at_"), (at if row is None else row).alias("row_"), F.col("doc_id"), source.alias("source"), *named(source),
        F.size(words(F.col("text"))).cast("long").alias("size"),
        F.xxhash64(F.lit(SEED), F.col("doc_id"), F.col("text")).alias("r"), *row_key(F.col("doc_id"), F.col("text"), source)))
    return materialize(copies(read).withColumn("r", F.when(F.col("copy") > 1, F.xxhash64("r", "copy")).otherwise(F.col("r"))))


def ranked(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """``df`` (of n rows) with ``i``, its rank from 0: ranges of RANKED rows are ranked side by side."""
    placed = materialize(df.repartitionByRange(max(1, -(-n // RANKED)), *order).withColumn("range_", F.spark_partition_id()))
    upto = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = placed.groupBy("range_").agg(F.count("*").alias("k")).select("range_", F.coalesce(F.sum("k").over(upto), F.lit(0)).alias("from_"))
    within = F.row_number().over(Window.partitionBy("range_").orderBy(*order)) - 1
    return placed.withColumn("at_", within).join(starts, "range_").withColumn("i", (F.col("at_") + F.col("from_")).cast("long")).drop("range_", "at_", "from_")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source_, no_source, i, source_size, n_docs, target) of each source, written."""
    per = materialize(sizes.groupBy(*SOURCE).agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs")))
    rows = ranked(per, [F.col("no_source"), F.col("source_")], per.count())
    one = materialize(rows.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("i") % len(weights) + 1).cast("int")))
                      .withColumn("cap", max_epochs * F.col("source_size")))
    level, stopped = 0.0, -1
    while True:  # rounds of resharing: each stops some sources for good, or is the last
        over = F.col("cap") <= F.lit(level) * F.col("weight")
        n, caps, open_, size = one.agg(F.count_if(over), F.sum(F.when(over, F.col("cap"))), F.sum(F.when(~over, F.col("weight"))), F.sum("source_size")).first()
        if n == stopped or not open_:
            break
        stopped, level = n, (total * size - (caps or 0)) / open_
    share = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("weight")) if open_ else F.col("cap").cast("double")
    return materialize(one.select(*SOURCE, "i", "source_size", "n_docs", share.alias("target")))


def log_factorial(n: Column) -> Column:
    """ln n!, by Stirling's series at n + 8 and the eight factors between (error below 1e-10)."""
    m = n.cast("double") + 8
    series = (m + 0.5) * F.log(m) - m + 0.5 * math.log(2 * math.pi) + 1 / (12 * m) - 1 / (360 * m * m * m) + 1 / (1260 * m * m * m * m * m)
    factors = n.cast("double") + 1
    for k in range(2, 9):
        factors = factors * (n.cast("double") + k)
    return series - F.log(factors)


def hypergeometric(pop: Column, good: Column, draws: Column, u: Column) -> Column:
    """How many of ``draws`` out of ``pop`` hit the ``good`` ones, by inverse CDF at ``u``.

    The sum runs over ten standard deviations on both sides of the mean: what lies beyond is below double precision.
    """
    lo0, hi0 = F.greatest(F.lit(0), draws + good - pop), F.least(draws, good)
    mean = draws * good / F.greatest(pop, F.lit(1))
    spread = F.sqrt(F.greatest(mean * (1 - good / F.greatest(pop, F.lit(1))), F.lit(0.0))) * 10 + 10
    lo = F.greatest(lo0, F.floor(mean - spread)).cast("long")
    hi = F.least(hi0, F.ceil(mean + spread)).cast("long")
    choose = lambda n, k: log_factorial(n) - log_factorial(k) - log_factorial(n - k)
    start = F.exp(choose(good, lo) + choose(pop - good, draws - lo) - choose(pop, draws))

    def add(s: Column, k: Column) -> Column:
        done = s["cdf"] >= u
        ratio = (good - k).cast("double") * (draws - k) / ((k + 1).cast("double") * (pop - good - draws + k + 1))
        return F.struct((s["cdf"] + F.when(done, 0.0).otherwise(s["pmf"] * ratio)).alias("cdf"), F.when(done, s["pmf"]).otherwise(s["pmf"] * ratio).alias("pmf"),
                        (s["k"] + F.when(done, 0).otherwise(1)).cast("long").alias("k"))

    steps = F.when(hi > lo, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(steps, F.struct(start.alias("cdf"), start.alias("pmf"), lo.alias("k")), add, lambda s: s["k"])


def left_shares(cells: DataFrame, n: int, depth: int = 0) -> DataFrame:
    """``cells(shard, width, i, draws)`` with ``left``: how many of each cell's draws the left half of its node takes.

    ``i`` runs from 0 to n - 1. A node's cells are split in groups of GROUP; if there are several groups, the groups'
    totals are split first, by the same rule."""
    groups = cells.groupBy("shard", "width", F.floor(F.col("i") / GROUP).alias("g")).agg(
        F.sort_array(F.collect_list(F.struct("i", "draws"))).alias("q"), F.sum("draws").alias("pop"))  # at most GROUP entries
    if n > GROUP:
        groups = materialize(groups)
        above = left_shares(groups.select("shard", "width", F.col("g").alias("i"), F.col("pop").alias("draws")), -(-n // GROUP), depth + 1)
        groups = groups.join(above.select("shard", F.col("i").alias("g"), F.col("left").alias("take")), ["shard", "g"])
    else:
        groups = groups.withColumn("take", F.floor(F.col("pop") * F.floor(F.col("width") / 2) / F.col("width")).cast("long"))
    u = lambda x: (F.pmod(F.xxhash64(F.lit(SEED), F.col("shard"), F.col("width"), F.lit(depth), x["i"]), F.lit(1 << 52)) + 0.5) / float(1 << 52)

    def draw(s: Column, x: Column) -> Column:
        return let(hypergeometric(s["pop"], x["draws"], s["take"], u(x)), lambda k: F.struct(
            (s["pop"] - x["draws"]).alias("pop"), (s["take"] - k).alias("take"),
            F.concat(s["out"], F.array(F.struct(x["i"].alias("i"), x["draws"].alias("draws"), k.alias("left")))).alias("out")))

    none = F.array().cast("array<struct<i:bigint,draws:bigint,left:bigint>>")
    drawn = F.aggregate("q", F.struct(F.col("pop").alias("pop"), F.col("take").alias("take"), none.alias("out")), draw, lambda s: s["out"])
    return groups.select("shard", "width", F.explode(drawn).alias("x")).select("shard", "width", "x.*")


def split_quotas(quotas: DataFrame, shards: int, n: int) -> DataFrame:
    """(i, shard, lo, hi): runs of block draws per shard, from ``quotas(i, draws)`` of the sources 0 to n - 1.

    The tree's cells are rows (node, source); a level turns each node into two."""
    cells = materialize(quotas.select(F.lit(0).alias("shard"), F.lit(shards).alias("width"), F.col("i").cast("long").alias("i"), F.col("draws").cast("long").alias("draws")))
    for _ in range(max(0, math.ceil(math.log2(shards)))):
        half = F.floor(F.col("width") / 2).cast("int")
        both = left_shares(cells.filter("width > 1"), n).select(F.explode(F.array(
            F.struct(F.col("shard"), half.alias("width"), F.col("i"), F.col("left").alias("draws")),
            F.struct((F.col("shard") + half).alias("shard"), (F.col("width") - half).alias("width"), F.col("i"), (F.col("draws") - F.col("left")).alias("draws")))).alias("n")).select("n.*")
        cells = materialize(cells.filter("width = 1").unionByName(both))
    run = Window.partitionBy("i").orderBy("shard")
    return cells.withColumn("hi", F.sum("draws").over(run)).select("i", "shard", (F.col("hi") - F.col("draws")).alias("lo"), "hi")


def mix(docs: DataFrame, row: Column | None = None, **kw) -> DataFrame:
    """draws() of ``docs``; ``row`` is a column that tells rows apart, for row_."""
    return draws(sized(docs, row), **kw).drop(*KEY, "copy")


def draws(sizes: DataFrame, weights: tuple = WEIGHTS, total: float = TOTAL, max_epochs: int = MAX_EPOCHS, shards: int | None = None, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """One row per document: row_, doc_id, source, size, source_size, target, taken, and ``draws``, an array of
    (shard, order_key, words): once per whole epoch and once for the part of the last epoch, from sized(). Without
    ``shards`` there are as many as SHARD_WORDS asks for."""
    goals = materialize(targets(sizes, weights, total, max_epochs)
                        .withColumn("blocks", F.ceil(F.col("n_docs") / block_docs))
                        .withColumn("goal", F.round("target").cast("long"))
                        .withColumn("epochs", F.coalesce(F.expr("try_divide(goal - goal % source_size, source_size)").cast("long"), F.lit(0).cast("long")))
                        .withColumn("rest", F.col("goal") - F.col("epochs") * F.col("source_size")))
    n_sources, goal = goals.agg(F.count("*"), F.sum("goal")).first()
    shards = shards or max(LEAST_SHARDS, 1 << math.ceil(math.log2(max(1, (goal or 0) / SHARD_WORDS))))
    placed = (sizes.join(goals.select(*SOURCE, "i", "source_size", "target", "blocks"), SOURCE)
              .withColumn("block", F.pmod(F.col("r"), F.col("blocks"))).drop("blocks", *SOURCE))
    # Words and blocks before each block of its source: over the blocks of a part, and over the parts.
    blocks = materialize(placed.groupBy("i", "block").agg(F.sum("size").alias("block_size")).withColumn("part", F.floor(F.col("block") / FAN)))
    by_part = Window.partitionBy("i").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = blocks.groupBy("i", "part").agg(F.sum("block_size").alias("s"), F.count("*").alias("n")).select(
        "i", "part", F.coalesce(F.sum("s").over(by_part), F.lit(0)).alias("part_from"), F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("part_pos"))
    in_part = Window.partitionBy("i", "part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(blocks.withColumn("s", F.coalesce(F.sum("block_size").over(in_part), F.lit(0))).withColumn("n", F.count("*").over(in_part))
                         .join(parts, ["i", "part"]).join(goals.select("i", "epochs", "rest"), "i")
                         .select("i", "block", "epochs", "rest", (F.col("part_from") + F.col("s")).alias("block_from"), (F.col("part_pos") + F.col("n")).alias("pos")))
    quotas = materialize(starts.groupBy("i").agg(F.count("*").alias("n_blocks"), F.first("epochs").alias("epochs"), F.count_if(F.col("block_from") < F.col("rest")).alias("begun"))
                         .withColumn("draws", F.col("epochs") * F.col("n_blocks") + F.col("begun")))
    # A run of draws and the draws in it meet in stretches about as long as a source's mean run.
    stretch = F.greatest(F.lit(1).cast("long"), F.floor(F.col("draws") / shards)).alias("stretch")
    of_source = quotas.select("i", "n_blocks", stretch)
    runs = (split_quotas(quotas, shards, n_sources).filter("lo < hi").join(of_source.select("i", "stretch"), "i")
            .withColumn("at", F.explode(F.expr("sequence((lo - lo % stretch) div stretch, (hi - 1) div stretch)"))).select("i", "at", "shard", "lo", "hi"))
    epochs = F.filter(F.sequence(F.lit(0).cast("long"), F.col("epochs")), lambda e: (e < F.col("epochs")) | (F.col("block_from") < F.col("rest")))
    turns = (starts.join(of_source, "i").select("i", "block", "n_blocks", "pos", "stretch", F.explode(epochs).alias("epoch"))
             .withColumn("draw", F.col("epoch") * F.col("n_blocks") + F.col("pos")).withColumn("at", F.expr("draw div stretch")))
    plan = (turns.join(runs, ["i", "at"]).filter("lo <= draw and draw < hi").groupBy("i", "block").agg(F.sort_array(F.collect_list(F.struct("epoch", "shard"))).alias("turns")))  # max_epochs + 1 at most
    plan = materialize(starts.select("i", "block", "block_from", "epochs", "rest").join(plan, ["i", "block"], "left"))
    in_block = Window.partitionBy("i", "block").orderBy("r", "doc_id", "size", "row_").rowsBetween(Window.unboundedPreceding, -1)
    of_block = placed.withColumn("before", F.coalesce(F.sum("size").over(in_block), F.lit(0))).join(plan, ["i", "block"])
    part_words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("rest") - F.col("block_from") - F.col("before")))
    taken = F.filter(F.transform(F.coalesce("turns", F.array().cast("array<struct<epoch:bigint,shard:int>>")), lambda t: F.struct(
        t["shard"].alias("shard"), F.xxhash64(F.lit(SEED), t["shard"], t["epoch"], F.col("r")).alias("order_key"),
        F.when(t["epoch"] < F.col("epochs"), F.col("size")).otherwise(part_words).alias("words"))), lambda d: d["words"] > 0)
    return of_block.withColumn("draws", taken).select(
        "row_", *KEY, "copy", "doc_id", "source", "size", "source_size", "target", F.aggregate("draws", F.lit(0).cast("long"), lambda a, x: a + x["words"]).alias("taken"), "draws")


def op9(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "draws")


def mixed(docs: DataFrame, shards: int | None = None, **kw) -> DataFrame:
    """The mix itself with the columns of ``docs``: a row per draw, the partial one cut to its first words.

    The rows of a shard are together, in the order of their keys, so writing the result writes shuffled shards. Plans
    meet their documents by row_key and number of the copy. Only rows that repeat are written once more to be numbered."""
    sizes = sized(docs)
    plan = materialize(draws(sizes, shards=shards, **kw).select(*KEY, "copy", "size", "draws"))
    n_shards = plan.agg(F.max(F.array_max(F.transform("draws", lambda d: d["shard"])))).first()[0]
    n_shards, plan = shards or (n_shards or 0) + 1, plan.filter(F.size("draws") > 0)
    repeated = materialize(sizes.filter("copy = 2").select(*KEY))
    rows = docs.select(F.struct("*").alias("doc_"), *row_key(F.col("doc_id"), F.col("text"), F.col("source").cast("string")))
    single = rows.join(repeated, KEY, "left_anti").withColumn("copy", F.lit(1).cast("long"))
    again = copies(materialize(rows.join(repeated, KEY, "left_semi").withColumn("at_", F.monotonically_increasing_id())))
    met = single.unionByName(again).join(plan.hint("shuffle_hash"), [*KEY, "copy"])
    drawn = met.withColumn("draw", F.explode("draws"))
    drawn = drawn.repartition(n_shards, "draw.shard").sortWithinPartitions("draw.shard", "draw.order_key")
    text = F.when(F.col("draw.words") >= F.col("size"), of_box("text")).otherwise(F.array_join(F.slice(words(of_box("text")), F.lit(1), F.col("draw.words").cast("int")), " "))
    changed = {"text": text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return unboxed(drawn, **changed)
