"""Variable-capacity best-fit packing of documents into training sequences.

Documents are dealt by hash into shards of about ``shard_tokens``; each shard is packed by itself, so no task ever
holds more than a shard's lengths. Texts longer than the largest capacity are cut into full pieces and a rest. In a
shard, pieces are placed longest first into the open bin that they leave with the least room. If none has room, a bin
is opened: of the permitted sizes that hold the piece, up to a ceiling, the one of least cost per token that is still
there to fill it. Packing is done once per ceiling (the permitted sizes are thus optimised jointly); every bin is then
downsized to the smallest permitted size that holds its contents, and the ceiling of least total cost is kept.

The cost of a bin of size c is ``overhead + c + c * c / quadratic``: launch, linear work, attention.

Defined results: null and empty texts have no words and only their end token; null doc_ids are packed like any
other; repeated rows are packed each; an empty table packs to nothing; extra columns are ignored.
"""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, table, words

CAPACITIES = (512, 1024, 2048, 4096, 8192)
SHARD_TOKENS = 4_000_000
OVERHEAD, QUADRATIC = 32.0, 65536.0
SCHEMA = "doc_id long, piece int, n_tokens long, bin_id string, capacity long, bin_used long, bin_offset long"


def bin_cost(c: float, overhead: float = OVERHEAD, quadratic: float = QUADRATIC) -> float:
    return overhead + c + c * c / quadratic


def best_fit(sizes: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: float = OVERHEAD, quadratic: float = QUADRATIC) -> tuple[list[int], list[int]]:
    """(bin of each piece, final capacity of each bin). No piece may exceed the largest capacity."""
    capacities = tuple(sorted(capacities))
    cost = {c: bin_cost(c, overhead, quadratic) for c in capacities}
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))
    best = None
    for ceiling in capacities:
        if sizes and sizes[order[0]] > ceiling:
            continue
        room: list[int] = []  # distinct rooms of open bins, ascending
        open_bins: dict[int, list[int]] = {}
        used: list[int] = []
        where = [0] * len(sizes)
        left = sum(sizes)
        for i in order:
            s = sizes[i]
            at = bisect.bisect_left(room, s)
            if at < len(room):
                had = room[at]
                b = open_bins[had].pop()
                if not open_bins[had]:
                    del open_bins[had], room[at]
            else:
                fits = [c for c in capacities if s <= c <= ceiling]
                had = min(fits, key=lambda c: (cost[c] / max(1, min(c, left)), c))
                b = len(used)
                used.append(0)
            where[i] = b
            used[b] += s
            left -= s
            if had - s:
                if had - s not in open_bins:
                    bisect.insort(room, had - s)
                    open_bins[had - s] = []
                open_bins[had - s].append(b)
        final = [capacities[bisect.bisect_left(capacities, u)] for u in used]
        total = sum(cost[c] for c in final)
        if best is None or total < best[0]:
            best = (total, where, final)
    return (best[1], best[2]) if best else ([], [])


def pack(docs: DataFrame, length=None, capacities: tuple[int, ...] = CAPACITIES, shard_tokens: int = SHARD_TOKENS,
         overhead: float = OVERHEAD, quadratic: float = QUADRATIC) -> DataFrame:
    """One row per piece of a document: doc_id, piece, n_tokens, bin_id, capacity, bin_used, bin_offset.

    ``length`` is a column with a document's tokens; by default its words and an end token.
    """
    largest = max(capacities)
    length = F.size(words(F.col("text"))) + 1 if length is None else length
    sized = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.greatest(F.lit(1).cast("long"), length.cast("long")).alias("n"),
                                    F.monotonically_increasing_id().alias("row")))
    shards = max(1, -(-(sized.agg(F.sum("n")).first()[0] or 0) // shard_tokens))
    # A few spare shards keep every executor busy on small inputs without changing how a shard is packed.
    shards = max(shards, 8)
    pieces = (sized.withColumn("piece", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / largest).cast("int"))))
              .withColumn("size", F.least(F.lit(largest).cast("long"), F.col("n") - F.col("piece") * F.lit(largest)))
              .withColumn("shard", F.pmod(F.xxhash64("doc_id", "row", "piece"), F.lit(shards))))

    def shard(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["doc_id", "row", "piece"], ignore_index=True)
        where, final = best_fit(g["size"].tolist(), capacities, overhead, quadratic)
        g["b"] = where
        by_bin = g.groupby("b")["size"]
        return pd.DataFrame({
            "doc_id": g["doc_id"].astype("Int64"), "piece": g["piece"], "n_tokens": g["size"], "bin_id": f"{int(g['shard'].iloc[0])}-" + g["b"].astype(str),
            "capacity": np.array(final, np.int64)[where], "bin_used": by_bin.transform("sum"), "bin_offset": by_bin.cumsum() - g["size"]})

    return pieces.select("doc_id", "row", "piece", "size", "shard").groupBy("shard").applyInPandas(shard, SCHEMA)


def op3(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
