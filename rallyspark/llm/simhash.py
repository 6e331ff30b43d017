"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are computed in Arrow batches. Equal fingerprints are grouped first, so that copies cost nothing
more. Distinct fingerprints are then dealt into tiles by the population counts of their four 16-bit quarters: the
Hamming distance is at least the sum of the quarters' count differences, so tile pairs whose counts differ beyond
the radius hold no link and are never formed. Each remaining pair of tiles meets in one group, where numpy
exclusive-or and bit counts compare them exactly in blocks. A group reports a spanning forest of its links (no
more rows than fingerprints), and components() joins the forests.

Defined results: null text counts as empty; a document without words has fingerprint zero and links like any
other; repeated doc_ids are rows of their own; null doc_ids never name a component unless all are null.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER, components, materialize, table

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Side of a comparison block: 2048 x 2048 distances take 32 MB as 64-bit words.
BLOCK = 2048
#: Most fingerprints that one group compares at home; larger tiles are dealt into parts of about this size.
TILE_ROWS = 50_000
#: Shingle hashes counted at once (64 bytes each once unpacked).
CHUNK = 100_000
_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shingle_hashes(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """XXH64 (seed 42) of every k-word shingle; of the whole word sequence if it is shorter; none without words."""
    found = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # splits at the six ASCII spaces
    if not found:
        return np.empty(0, np.uint64)
    digest, n = xxhash.xxh64_intdigest, len(found)
    if n <= k:
        return np.array([digest(b" ".join(found), SEED)], np.uint64)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, n) + 1) - 1
    starts = np.concatenate([[0], ends[: n - k] + 1]).tolist()
    return np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts, ends[k - 1:].tolist())), np.uint64, n - k + 1)


def fingerprints(texts: list[str | None], k: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints: a bit is set where over half of a text's shingle hashes have it."""
    ones, sizes = np.zeros((len(texts), 64), np.int64), np.zeros(len(texts), np.int64)
    held: list[np.ndarray] = []
    owners: list[int] = []

    def count() -> None:
        if held:
            bits = np.unpackbits(np.concatenate(held).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            at = np.cumsum([0, *map(len, held[:-1])])
            np.add.at(ones, owners, np.add.reduceat(bits, at, axis=0, dtype=np.int64))
            held.clear()
            owners.clear()

    waiting = 0
    for i, text in enumerate(texts):
        h = shingle_hashes(text, k)
        sizes[i] = len(h)
        for part in (h[j: j + CHUNK] for j in range(0, len(h), CHUNK)):
            held.append(part)
            owners.append(i)
            waiting += len(part)
            if waiting >= CHUNK:
                count()
                waiting = 0
    count()
    return np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()


def with_fingerprint(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long) of every document, written to the shared folder."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                fp = fingerprints(part.column(1).to_pylist(), k).astype(np.int64, casting="unsafe")
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], ["doc_id", "fp"])

    return materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(batches, "doc_id long, fp long"))


def links(left: np.ndarray, right: np.ndarray, radius: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i of left, j of right; i < j if they are the same list) within ``radius`` bits, block by block.

    Both sides are sorted by population count first, and a pair of blocks whose count ranges lie further apart
    than the radius is skipped.
    """
    lo, ro = np.argsort(np.bitwise_count(left), kind="stable"), np.argsort(np.bitwise_count(right), kind="stable")
    for i in range(0, len(left), BLOCK):
        a = lo[i: i + BLOCK]
        a_low, a_high = np.bitwise_count(left[a[[0, -1]]]).astype(int)
        for j in range(i if same else 0, len(right), BLOCK):
            b = ro[j: j + BLOCK]
            b_low, b_high = np.bitwise_count(right[b[[0, -1]]]).astype(int)
            if b_low - a_high > radius or a_low - b_high > radius:
                continue
            x, y = np.nonzero(np.bitwise_count(left[a][:, None] ^ right[b][None, :]) <= radius)
            if same and i == j:
                x, y = x[x < y], y[x < y]
            if len(x):
                yield a[x], b[y]


def _forest(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The root of each of n nodes under the links given, by repeated minimum and pointer jumping."""
    root = np.arange(n)
    for x, y in pairs:
        while True:
            rx, ry = root[x], root[y]
            apart = rx != ry
            if not apart.any():
                break
            x, y = x[apart], y[apart]
            np.minimum.at(root, np.maximum(rx[apart], ry[apart]), np.minimum(rx[apart], ry[apart]))
            while not np.array_equal(root, jumped := root[root]):
                root = jumped
    return root


def _neighbours(radius: int) -> list[tuple[int, ...]]:
    """Count differences of the four quarters that fingerprints within ``radius`` can have, own tile and later ones."""
    near = [d for d in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, d)) <= radius]
    return [d for d in near if d >= (0, 0, 0, 0)]


def near_links(distinct: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """A spanning forest (a, b) of all links between the ``fp`` of ``distinct`` (no repeats)."""
    quarters = [F.bit_count(F.shiftrightunsigned(F.col("fp"), 16 * q).bitwiseAND(F.lit(0xFFFF))) for q in range(4)]
    counted = distinct.select("fp", *[c.cast("int").alias(f"q{q}") for q, c in enumerate(quarters)])
    # Tiles above tile_rows are dealt into parts by hash: each visitor goes to every part of the tile it visits.
    code = lambda cols: sum((c * F.lit(17 ** q) for q, c in enumerate(cols)), F.lit(0))
    home = code([F.col(f"q{q}") for q in range(4)])
    tiles = materialize(counted.groupBy(home.alias("tile")).agg(F.count("*").alias("n"))
                        .select("tile", F.ceil(F.col("n") / tile_rows).cast("int").alias("parts")))  # at most 17^4 rows
    steps = F.array(*[F.struct(F.lit(sum(x * 17 ** q for q, x in enumerate(d))).alias("step"), *[F.lit(x).alias(f"d{q}") for q, x in enumerate(d)])
                      for d in _neighbours(radius)])
    visits = counted.select("fp", "q0", "q1", "q2", "q3", F.explode(steps).alias("s")).filter(
        " and ".join(f"q{q} + s.d{q} between 0 and 16" for q in range(4))).select(
        "fp", (home + F.col("s.step")).alias("tile"), (F.col("s.step") == 0).alias("own"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts"))
    dealt = (visits.join(F.broadcast(tiles), "tile").select(
        "fp", "tile", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), part.alias("at"))
        .select("fp", "tile", "part", (F.col("own") & (F.col("at") == F.col("part"))).alias("home"),
                (F.col("own") & (F.col("at") < F.col("part"))).alias("earlier"), "own")
        .filter("home or earlier or not own").select("fp", "tile", "part", "home"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        fp, at_home = group["fp"].to_numpy(), group["home"].to_numpy()
        order = np.argsort(~at_home, kind="stable")
        fp, n = fp[order].astype(np.uint64), int(at_home.sum())
        if not n:
            return pd.DataFrame({"a": [], "b": []}, dtype="int64")
        here, there = fp[:n], fp[n:]
        found = itertools.chain(links(here, here, radius, True), ((x, y + n) for x, y in links(here, there, radius, False)))
        root = _forest(len(fp), found)
        linked = np.flatnonzero(root != np.arange(len(fp)))
        return pd.DataFrame({"a": fp[linked].astype(np.int64), "b": fp[root[linked]].astype(np.int64)})

    return dealt.groupBy("tile", "part").applyInPandas(compare, "a long, b long")


def near_components(docs: DataFrame, radius: int = RADIUS, k: int = SHINGLE) -> tuple[DataFrame, DataFrame]:
    """((doc_id, fp) rows, (fp, component_id, size) of each fingerprint whose component has several documents)."""
    rows = with_fingerprint(docs, k)
    groups = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")))
    roots = components(materialize(near_links(groups.select("fp"), radius)))
    placed = materialize(groups.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", "n", F.coalesce("root", "fp").alias("root")))
    named = materialize(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.sum("n").alias("size")).filter("size > 1"))
    return rows, materialize(placed.join(named, "root").select("fp", "component_id", "size"))


def simhash_near_dedup(docs: DataFrame, radius: int = RADIUS, k: int = SHINGLE) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, component_size."""
    rows, several = near_components(docs, radius, k)
    return rows.join(several, "fp", "left").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("component_size"))


def op4(spark, sf_dir: str) -> DataFrame:
    return simhash_near_dedup(table(spark, sf_dir, "documents"))
