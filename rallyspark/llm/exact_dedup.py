"""Exact deduplication by static binary-fuse filters per immutable snapshot.

Documents arrive in batches. A batch is first grouped within itself by digest; its distinct digests are screened
against the 3-wise binary-fuse filter of every earlier snapshot (no false negatives, about 0.4 % false
positives); what passes is joined to the snapshot's exact buckets and the two texts are compared byte for byte.
The batch then becomes a snapshot with a filter of its own; filters are never updated.

Defined results: null text counts as empty; texts are equal when identical after lower-casing A-Z only; of equal
texts the row with the largest doc_id stays (null ids sort lowest; among repeated rows of one id exactly one
stays); an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import KEY, ascii_lower, few, materialize, row_key, without

#: Most keys that one filter is meant to hold; filters are split by digest so that each stays about this small.
KEYS_PER_FILTER, LEAST_BUCKETS = 100_000, 256


def _mix(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys.astype(np.uint64) + np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h ^ (h >> np.uint64(33))


def _places(h: np.ndarray, segment: int, segments: int) -> np.ndarray:
    """The three slots of each key, one in each of three neighbouring segments: shape (3, n)."""
    mask = np.uint64(segment - 1)
    first = ((h >> np.uint64(32)) * np.uint64(segments * segment)) >> np.uint64(32)
    second = (first + np.uint64(segment)) ^ ((h >> np.uint64(18)) & mask)
    third = (first + np.uint64(2 * segment)) ^ (h & mask)
    return np.stack([first, second, third]).astype(np.int64)


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFF)).astype(np.uint8)


def build_filter(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """(seed, segment length, segments, fingerprints) of a filter that holds ``keys`` (64-bit, any repeats)."""
    keys = np.unique(np.asarray(keys).astype(np.uint64))
    n = max(len(keys), 2)
    segment = 1 << max(2, min(18, int(math.floor(math.log(n) / math.log(3.33) + 2.25))))
    slots = int(round(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(n))))
    segments = max(1, -(-slots // segment) - 2)
    for seed in range(1, 200):
        h = _mix(keys, seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
        at = _places(h, segment, segments)
        size = (segments + 2) * segment
        count = np.bincount(at.ravel(), minlength=size)
        owner = np.zeros(size, np.int64)
        np.bitwise_xor.at(owner, at, np.broadcast_to(np.arange(len(keys)), at.shape))
        peeled, left = [], len(keys)
        while left:
            slots_1 = np.flatnonzero(count == 1)
            if not len(slots_1):
                break
            who, first = np.unique(owner[slots_1], return_index=True)
            peeled.append((who, slots_1[first]))
            np.subtract.at(count, at[:, who], 1)
            np.bitwise_xor.at(owner, at[:, who], np.broadcast_to(who, (3, len(who))))
            left -= len(who)
        if left:
            segments += 1  # a little more room, another seed
            continue
        table, prints = np.zeros(size, np.uint8), _prints(h)
        for who, slot in reversed(peeled):
            table[slot] = 0
            table[slot] = prints[who] ^ np.bitwise_xor.reduce(table[at[:, who]], axis=0)
        return seed, segment, segments, table.tobytes()
    raise RuntimeError("no seed peels; are the keys distinct?")


def might_contain(keys: np.ndarray, seed: int, segment: int, segments: int, table: bytes) -> np.ndarray:
    h = _mix(np.asarray(keys).astype(np.uint64), seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    return np.bitwise_xor.reduce(np.frombuffer(table, np.uint8)[_places(h, segment, segments)], axis=0) == _prints(h)


def digest_of(text: Column) -> Column:
    """SHA-256 of a text after lower-casing A-Z."""
    return F.sha2(ascii_lower(text).cast("binary"), 256)


def short_hash(text: Column) -> Column:
    return F.xxhash64(F.lit(11), text)


def digests(docs: DataFrame, batches: int, more: list[Column] | None = None) -> DataFrame:
    """(doc_id, digest, h, row_, batch) and ``more`` of each document, written to the shared folder; ``row_`` tells repeats apart
    and ``h``, a short hash of the normalised text, finds it again without its digest."""
    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(F.col("text")).alias("digest"), short_hash(ascii_lower(F.col("text"))).alias("h"), F.monotonically_increasing_id().alias("row_"),
                                   F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), *(more or [])))


def build_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """One filter row per digest bucket of a snapshot's ``groups(digest)``."""
    def build(bucket: pd.DataFrame) -> pd.DataFrame:
        seed, segment, segments, table = build_filter(bucket["key"].to_numpy())
        return pd.DataFrame([(bucket["bucket"].iloc[0], seed, segment, segments, table)], columns=["bucket", "seed", "segment", "segments", "prints"])

    return materialize(_keyed(groups, buckets).select("bucket", "key").groupBy("bucket").applyInPandas(
        build, "bucket long, seed long, segment long, segments long, prints binary"))


def _keyed(groups: DataFrame, buckets: int) -> DataFrame:
    key = F.xxhash64("digest")
    return groups.withColumn("key", key).withColumn("bucket", F.pmod(key, F.lit(buckets)))


def screen(groups: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """Those digests of ``groups`` that the snapshot's filters may hold: bucket meets bucket, one filter in memory."""
    def probe(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(right) or not len(left):
            return left[["digest"]].iloc[:0]
        f = right.iloc[0]
        return left.loc[might_contain(left["key"].to_numpy(), int(f.seed), int(f.segment), int(f.segments), f.prints), ["digest"]]

    return _keyed(groups.select("digest"), buckets).groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInPandas(probe, "digest string")


def _verified(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of ``pairs(digest, h, a, b, new, old)`` whose documents ``new`` and ``old`` hold the same bytes.

    Texts are found by id and hash of the text together, so that many rows of one id (or of none) meet their own digests only."""
    wanted = materialize(pairs.select(F.explode(F.array("new", "old")).alias("wanted"), "h", F.col("digest").alias("of")).distinct())
    text = ascii_lower(F.col("text"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), short_hash(text).alias("h"))
    found = texts.join(few(wanted), (texts["h"] == wanted["h"]) & F.col("doc_id").eqNullSafe(F.col("wanted")))
    same = (found.filter(F.sha2(F.col("text").cast("binary"), 256) == F.col("of")).groupBy(F.col("of").alias("digest"))
            .agg((F.min("text") == F.max("text")).alias("same")).filter("same").select("digest"))
    return pairs.join(same, "digest", "left_semi")


def exact_groups(docs: DataFrame, rows: DataFrame, batches: int = 2) -> DataFrame:
    """groups(digest, batch, keep_id, keep_row, group_size) of each batch's digests, from ``docs`` and their digests()."""
    groups = materialize(rows.groupBy("batch", "digest").agg(F.max(F.struct("doc_id", "row_")).alias("keep"), F.max("h").alias("h"), F.count("*").alias("n")))
    buckets = max(LEAST_BUCKETS, -(-groups.count() // KEYS_PER_FILTER))
    snapshots: list[tuple[int, DataFrame, DataFrame]] = []
    pairs = None
    for b in range(batches):
        own = groups.filter(F.col("batch") == b)
        for a, old, filters in snapshots:
            hit = screen(own, filters, buckets)
            found = (hit.join(own, "digest").select("digest", "h", F.col("keep.doc_id").alias("new"))
                     .join(old.select("digest", F.col("keep.doc_id").alias("old")), "digest")
                     .select("digest", "h", F.lit(a).alias("a"), F.lit(b).alias("b"), "new", "old"))
            pairs = found if pairs is None else pairs.unionByName(found)
        if b < batches - 1:
            snapshots.append((b, own, build_filters(own, buckets)))
    if pairs is None:
        return groups.select("digest", "batch", F.col("keep.doc_id").alias("keep_id"), F.col("keep.row_").alias("keep_row"), F.col("n").alias("group_size"))
    linked = _verified(docs, materialize(pairs))
    members = materialize(linked.select("digest", F.explode(F.array("a", "b")).alias("batch")).distinct())
    merged = (groups.join(members, ["digest", "batch"], "left_semi").groupBy("digest")
              .agg(F.max("keep").alias("all_keep"), F.sum("n").alias("all_n"))
              .join(members, "digest").select("digest", "batch", "all_keep", "all_n"))
    out = groups.join(merged, ["digest", "batch"], "left").withColumn("best", F.coalesce("all_keep", "keep"))
    return materialize(out.select("digest", "batch", F.col("best.doc_id").alias("keep_id"), F.col("best.row_").alias("keep_row"),
                                  F.coalesce("all_n", "n").alias("group_size")))


def exact_dedup(docs: DataFrame, batches: int = 2) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    rows = digests(docs, batches)
    many = exact_groups(docs, rows, batches).filter("group_size > 1")  # the rest need no join; AQE splits the hot digests of this one
    joined = rows.join(many, ["digest", "batch"], "left")
    alone = F.col("group_size").isNull()
    return joined.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                         F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                         (alone | (F.col("row_") == F.col("keep_row"))).alias("kept"), F.col("digest").alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, batches: int = 2) -> DataFrame:
    """``docs`` without the rows that exact_dedup drops; all columns stay, whatever their names."""
    key = row_key(F.col("doc_id").cast("long"), ascii_lower(F.col("text")))
    rows = digests(docs, batches, key)
    many = exact_groups(docs.select("doc_id", "text"), rows.drop(*KEY), batches).filter("group_size > 1")
    # Rows of one key are equal in id and text: does one of them stay, and how many are there?
    keys = materialize(rows.join(many, ["digest", "batch"]).groupBy(*KEY).agg(F.max(F.col("row_") == F.col("keep_row")).alias("stays"), F.count("*").alias("n")))
    return without(docs, key, keys.filter("not stays").select(*KEY), keys.filter("stays and n > 1").select(*KEY))


def op2(spark, sf_dir: str) -> DataFrame:
    from .common import table
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH t AS (SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
           FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
