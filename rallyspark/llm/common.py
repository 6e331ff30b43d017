"""What the training-data operators share: table reading, shared-folder tables, word splitting, components."""

from __future__ import annotations

import tempfile
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space that separates words everywhere in this subpackage: space, tab, LF, VT, FF, CR.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder's URI under the cluster's shared checkpoint folder.

    The folder comes from ``spark.checkpoint.dir``. Only a local-mode session without that setting
    (tests, a notebook) gets a temporary one; a cluster without it is an error, since executors do
    not share local folders.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    if not urlparse(base).scheme:
        base = f"file://{base}"
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut and survives lost executors."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame) -> DataFrame:
    """``df``, a table of this subpackage, written to the shared folder with ``row_``, a number that tells its rows apart."""
    return materialize(df.withColumn("row_", F.monotonically_increasing_id()))


def boxed(docs: DataFrame, **more: Column) -> DataFrame:
    """``docs`` written to the shared folder as (row_, doc_, ...): ``doc_`` is a struct of all its columns, so none of
    them can clash with those that a stage adds, and ``row_`` tells rows apart whatever their ids. ``more`` are columns
    made from ``docs`` in the same pass."""
    return materialize(docs.select(F.monotonically_increasing_id().alias("row_"), F.struct("*").alias("doc_"), *[c.alias(name) for name, c in more.items()]))


def of_box(name: str) -> Column:
    """A column of the documents in boxed()."""
    return F.col("doc_").getField(name)


def unboxed(rows: DataFrame, **changed: Column) -> DataFrame:
    """The documents of boxed() again, with some columns changed."""
    return rows.select(*[(changed[c] if c in changed else of_box(c)).alias(c) for c in rows.schema["doc_"].dataType.names])


#: Key tables of at most this many rows (about 80 bytes each in memory) are broadcast; larger ones are shuffled.
BROADCAST_ROWS = 500_000
KEY = ["k1", "k2"]


def row_key(*columns: Column) -> list[Column]:
    """k1 and k2: a 128-bit hash of columns, nulls told apart. It finds a row again where a number of its own would need a
    copy of the whole table."""
    parts = [c for column in columns for c in (column.isNull(), column)]
    return [F.xxhash64(F.lit(seed), *parts).alias(name) for seed, name in ((1, "k1"), (2, "k2"))]


def few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def without(docs: DataFrame, key: list[Column], gone: DataFrame, once: DataFrame | None = None) -> DataFrame:
    """``docs`` without the rows whose row_key is in ``gone(k1, k2)``, and with one row of each key in ``once(k1, k2)``."""
    keyed = docs.select(F.struct("*").alias("doc_"), *key)
    left = keyed.join(few(gone), KEY, "left_anti")
    if once is None or once.isEmpty():
        return unboxed(left)
    once = few(once)
    return unboxed(left.join(once, KEY, "left_anti").unionByName(left.join(once, KEY, "left_semi").dropDuplicates(KEY)))


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z and nothing else; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))  # pure ASCII: lower() is exact and fast


def words(text: Column) -> Column:
    """Array of maximal runs of anything but the six ASCII white-space characters; null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1), lambda w: w != "")


def count_of(text: Column, chars: str) -> Column:
    """How many characters of ``text`` are in the regex class body ``chars``; null text has none."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), f"[^{chars}]+", "")).cast("long")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, where a plain reference might be inlined many times."""
    return F.element_at(F.transform(F.array(value), body), 1)


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)`` as ``(node, root)``; the root is some node of the component.

    Contraction: every node hooks onto the neighbour (or itself) that is least under a hash that changes each
    round, edges are rewritten to the hooks, and rounds go on until no edge is left. Each round shuffles only what
    is left of the edges, aggregates map-side, and is written to the shared folder; nothing visits the driver but
    one emptiness flag. Empty ``edges`` give an empty result; self links and repeats are harmless.
    """
    def dedup(df):
        return df.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    left, hooks = materialize(dedup(edges)), []
    for k in range(max_rounds):
        if left.isEmpty():
            break
        both = left.unionByName(left.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(k)).alias("h"), F.col(c).alias("n"))  # noqa: E731, B023
        hook = materialize(both.groupBy("a").agg(F.min(rank("b")).alias("m"))
                           .select(F.col("a").alias("node"), F.least("m", rank("a"))["n"].alias("to")))
        hooks.append(hook)
        left = materialize(dedup(
            left.join(hook.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a")
            .join(hook.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
            .select(F.col("ta").alias("a"), F.col("tb").alias("b"))))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    spark = edges.sparkSession
    if not hooks:
        return spark.createDataFrame([], T.StructType([T.StructField("node", T.LongType()), T.StructField("root", T.LongType())]))
    roots = hooks[-1].select("node", F.col("to").alias("root"))
    for hook in reversed(hooks[:-1]):
        later = roots.select(F.col("node").alias("to"), F.col("root").alias("r"))
        roots = materialize(hook.join(later, "to", "left").select("node", F.coalesce("r", "to").alias("root")))
    return roots
