"""Near copies of the corpus pipeline: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from min-hash bands: BANDS buckets per document, each the hash of BAND_ROWS minima, so a pair at
similarity s shares a bucket with probability 1 - (1 - s^BAND_ROWS)^BANDS (0.99999 at 0.8, 0.03 at 0.3: texts that share a
template seldom meet). Documents that shared buckets connect make a cluster, and each cluster's exact shingle sets meet once: sets of all its pairs are compared,
but for pairs that earlier links already join and pairs whose sizes alone exclude a link. Clusters above TILE_DOCS
documents or TILE_SHINGLES shingles are dealt into parts by hash, and pairs of parts meet, so no task holds more than
two parts. A tile reports a spanning forest of its links, no more rows than documents.

SimHash tiles, as in op4, don't serve here: similarity 0.8 means about 10 of 64 bits on average and 15 or more for good
recall, where the tiles' population counts exclude almost nothing and all pairs would be compared.

Defined results: null text counts as empty; texts of fewer than five words are one shingle; documents without words are
copies of each other. Rows are told apart by a row number, so null and repeated doc_ids are rows of their own. Of a
component the smallest doc_id stays (null ids last; of repeated ids one row). Extra columns stay, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed, components, few, materialize, of_box, unboxed
from .simhash import shingle_hashes

SHINGLE, BANDS, BAND_ROWS = 5, 40, 6
#: Least similarity as a fraction, so that the check is exact.
SIMILARITY = (4, 5)
#: Documents and shingles of a part of a cluster, about: a task holds two parts.
TILE_DOCS, TILE_SHINGLES = 2048, 2_000_000
_FACTORS, _OFFSETS = (np.random.default_rng(17 + i).integers(0, 1 << 64, BANDS * BAND_ROWS, np.uint64) | np.uint64(1 - i) for i in (0, 1))


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE))


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Bucket keys, (sets, BANDS); empty sets share theirs."""
    sets = [s if len(s) else np.zeros(1, np.uint64) for s in sets]
    flat, starts = np.concatenate(sets), np.cumsum([0, *map(len, sets[:-1])])
    keys = np.empty((len(sets), BANDS), np.uint64)
    for band in range(BANDS):
        h = np.full(len(sets), band + 1, np.uint64)
        for j in range(band * BAND_ROWS, (band + 1) * BAND_ROWS):
            h = (h ^ np.minimum.reduceat(flat * _FACTORS[j] + _OFFSETS[j], starts)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(31)
        keys[:, band] = h
    return keys.view(np.int64)


def _per_text(df: DataFrame, make, name: str) -> DataFrame:
    """(row_, ``name`` array<long>) from (row_, text): ``make`` gives the arrays of a list of texts."""
    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                arrays = make(part.column(1).to_pylist())
                ends = np.cumsum([0, *map(len, arrays)]).astype(np.int32)
                values = pa.array(np.concatenate(arrays).astype(np.int64, casting="unsafe"))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(ends), values)], ["row_", name])

    return df.select("row_", F.col("text").cast("string").alias("text")).mapInArrow(batches, f"row_ long, {name} array<bigint>")


def forest(sets: list[np.ndarray], n_left: int | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that connect whatever sets of enough similarity connect; with ``n_left``, only the first so many meet the rest.

    Each set meets those sets at once that it isn't connected to yet and whose size allows a link."""
    part, whole = SIMILARITY
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    flat, ends = np.concatenate([*sets, np.zeros(0, np.int64)]), np.cumsum(sizes)
    label, links = np.arange(n), []
    for i in range(n if n_left is None else n_left):
        to = i + 1 if n_left is None else n_left
        at = to + np.flatnonzero((label[to:] != label[i]) & (sizes[to:] * whole >= sizes[i] * part) & (sizes[i] * whole >= sizes[to:] * part))
        if not len(at):
            continue
        if sizes[i]:
            own, k = sets[i], sizes[at]  # none of them is empty, by size
            upto = np.cumsum(k)
            values = flat[np.repeat(ends[at] - upto, k) + np.arange(upto[-1])]
            shared = np.add.reduceat(own[np.minimum(np.searchsorted(own, values), len(own) - 1)] == values, upto - k, dtype=np.int64)
            at = at[shared * whole >= (k + sizes[i] - shared) * part]
        for j in at.tolist():
            if label[j] != label[i]:
                links.append((i, j))
                label[label == label[j]] = label[i]
    return links


def near_groups(docs: DataFrame) -> DataFrame:
    """(node, root): the component of each row of ``docs(row_, text)`` that has near copies."""
    signed = materialize(_per_text(docs, lambda texts: list(band_keys([shingle_set(t) for t in texts])), "keys"))
    placed = signed.select("row_", F.explode("keys").alias("key"))
    buckets = materialize(placed.groupBy("key").agg(F.min("row_").alias("a"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    clusters = components(placed.join(buckets, "key").filter("row_ <> a").select("a", F.col("row_").alias("b"))).select(F.col("node").alias("row_"), F.col("root").alias("cluster"))
    # One way at every size: the texts are shuffled once, to the rows that are in clusters.
    sets = materialize(_per_text(docs.select("row_", "text").join(clusters.select("row_").hint("shuffle_hash"), "row_"), lambda texts: [shingle_set(t) for t in texts], "s")
                       .join(clusters, "row_"))
    parts = materialize(sets.groupBy("cluster").agg(F.greatest(F.ceil(F.count("*") / TILE_DOCS), F.ceil(F.sum(F.size("s")) / TILE_SHINGLES)).cast("int").alias("parts")))
    dealt = (sets.join(parts, "cluster").withColumn("part", F.pmod(F.xxhash64("row_"), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.greatest(F.col("parts"), F.lit(1)) - 1)))
             .select("cluster", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "row_", "s"))

    def compare(key: tuple, tile: pd.DataFrame) -> pd.DataFrame:
        tile = tile.sort_values(["part", "row_"], ignore_index=True)
        n_left = None if key[1] == key[2] else int((tile["part"] == key[1]).sum())
        rows = tile["row_"].to_numpy()
        links = forest([np.sort(np.asarray(s, np.int64)) for s in tile["s"]], n_left)
        return pd.DataFrame({"a": rows[[i for i, _ in links]], "b": rows[[j for _, j in links]]}) if links else pd.DataFrame({"a": [], "b": []}, dtype="int64")

    return components(dealt.groupBy("cluster", "p", "q").applyInPandas(compare, "a long, b long"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near copies; all columns stay, whatever their names."""
    rows = boxed(docs)
    nodes = near_groups(rows.select("row_", of_box("text").alias("text")))
    of = materialize(nodes.withColumnRenamed("node", "row_").join(rows.select("row_", of_box("doc_id").cast("long").alias("doc_id")), "row_").select("root", "row_", "doc_id"))
    stay = of.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_"))["row_"].alias("row_"))
    gone = materialize(of.select("row_").join(stay.select("row_"), "row_", "left_anti"))
    return unboxed(rows.join(few(gone), "row_", "left_anti"))
