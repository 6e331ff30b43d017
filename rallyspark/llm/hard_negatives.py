"""Hard-negative mining by rotated one-bit codes: popcount estimates, exact intervals, integer scores.

Every vector is quantised to integers, rotated, and coded by the signs of its components; what a code leaves over is coded
by signs again, ``CODES`` times. With each code its alignment is stored (the inner product of the coded vector with the
code's unit vector), and the length of what the last code leaves. A tile of anchors and index rows is estimated by popcounts
of the codes against the bit planes of the rotated, rounded anchors; the Cauchy-Schwarz inequality bounds the error by the
leftover's length times the part of the anchor that is orthogonal to the last code, plus the anchor's rounding. No true
score lies outside its interval, so rows whose interval can't reach a tile's best are left out, and only the rest is scored
by integers. Results are exact: recall against brute force is 1.

Equal vectors of one label share an index row that names the first few of them, which is all that an anchor can want; so
thousands of copies cost one comparison. Index and anchors meet in tiles of bounded size, each read by one task.

Defined results: rows with a null label, a null vector, or a null or non-finite component take no part; nor do those with a
component beyond 2**20 in size, whose integer products could leave 64 bits. Vectors of different lengths are never compared.
Rows with a null vec_id are no anchors; as positives and negatives they follow the others of their score. Repeated rows count
each for itself. Of equal scores the smaller vec_id comes first. An anchor without another row of its label has no result, nor
has a positive whose score is negative. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table

CODES, PLANES = 6, 8
#: Index rows and anchors that meet in one task at most, and pairs that are estimated at a time.
TILE_ROWS, TILE_ANCHORS, PAIRS = 8192, 4096, 1 << 17
#: Largest component, before quantisation.
LARGEST = 2.0 ** 20
SEED = 20


@functools.cache
def rotation(d: int) -> np.ndarray:
    """A fixed random orthogonal matrix of d x d."""
    return np.linalg.qr(np.random.default_rng(SEED).standard_normal((d, d)))[0] if d else np.zeros((0, 0))


def _words(bits: np.ndarray) -> np.ndarray:
    """Booleans on the last axis packed into 64-bit words."""
    packed = np.packbits(bits, axis=-1)
    pad = -packed.shape[-1] % 8
    return np.ascontiguousarray(np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, pad)])).view(np.uint64)


def encode(v: np.ndarray, codes: int = CODES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of integer vectors (n, d): sign codes (n, codes, words), alignments (n, codes), lengths of what is coded and of what is left over."""
    n, d = v.shape
    turned = v @ rotation(d).T
    left, unit = turned.copy(), 1 / np.sqrt(max(d, 1))
    bits, aligned = np.zeros((n, codes, d), bool), np.zeros((n, codes))
    for k in range(codes):
        bits[:, k] = left >= 0
        signs = np.where(bits[:, k], unit, -unit)
        aligned[:, k] = (left * signs).sum(axis=1)
        left -= aligned[:, k, None] * signs
    return _words(bits), aligned, np.linalg.norm(turned - left, axis=1), np.linalg.norm(left, axis=1)


class Anchors:
    """Anchors made ready for popcounts: bit planes of their rotated, rounded components."""

    def __init__(self, v: np.ndarray, planes: int = PLANES):
        self.v, self.d = v, v.shape[1]
        turned = v @ rotation(self.d).T
        self.length = np.linalg.norm(turned, axis=1)
        self.low = turned.min(axis=1, initial=0)
        self.step = np.maximum((turned.max(axis=1, initial=0) - self.low) / ((1 << planes) - 1), 1e-12)
        steps = np.rint((turned - self.low[:, None]) / self.step[:, None]).astype(np.int64)
        rounded = self.low[:, None] + self.step[:, None] * steps
        self.total, self.off = rounded.sum(axis=1), np.linalg.norm(turned - rounded, axis=1)
        self.planes = np.stack([_words((steps >> b & 1).astype(bool)) for b in range(planes)], axis=1)


def intervals(codes: np.ndarray, aligned: np.ndarray, coded: np.ndarray, left: np.ndarray, a: Anchors, which: slice) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, bounds), each (rows, anchors): every true inner product is within its bound of its estimate."""
    unit = 1 / np.sqrt(max(a.d, 1))
    planes, off, length = a.planes[which], a.off[which], a.length[which]
    estimate = np.zeros((len(codes), len(planes)))
    inner = estimate
    for k in range(codes.shape[1]):
        weighted = np.zeros(estimate.shape, np.uint32)
        for b in range(planes.shape[1] - 1, -1, -1):  # Horner's rule over the bit planes
            weighted <<= 1
            for w in range(codes.shape[2]):
                weighted += np.bitwise_count(codes[:, k, w, None] & planes[None, :, b, w])
        ones = np.bitwise_count(codes[:, k]).sum(axis=1, dtype=np.int64)
        inner = unit * (2 * (a.low[which] * ones[:, None] + a.step[which] * weighted) - a.total[which])
        estimate += aligned[:, k, None] * inner
    across = np.sqrt(np.maximum(length ** 2 - np.maximum(np.abs(inner) - off, 0) ** 2, 0))
    slack = 1e-9 * (1 + (coded + left)[:, None] * length)
    return estimate, coded[:, None] * off + left[:, None] * across + slack


class Scores:
    """Integer scores of one anchor, each made when it is first asked for."""

    def __init__(self, v: np.ndarray, q: np.ndarray):
        self.v, self.q = v, q
        self.known, self.made = np.zeros(len(v), np.int64), np.zeros(len(v), bool)

    def of(self, rows: np.ndarray) -> np.ndarray:
        new = rows[~self.made[rows]]
        self.known[new] = self.v[new] @ self.q
        self.made[new] = True
        return self.known[rows]


def best(low: np.ndarray, high: np.ndarray, rows: np.ndarray, scores: Scores, k: int, least: int | None = None, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of those ``rows`` that can be among the first k with a score from ``least`` to ``most``, and all that tie
    with the k-th. ``low`` and ``high`` are the ends of the intervals of all rows."""
    def scored(at):
        s = scores.of(at)
        ok = np.ones(len(s), bool) if least is None else (s >= least) & (s <= most)
        return at[ok], s[ok]

    if least is not None:
        rows = rows[(high[rows] >= least) & (low[rows] <= most)]
    if len(rows) > 4 * k:  # a few good ones are scored first, and what can't reach the k-th of them is left out
        likely = low[rows] + high[rows]
        if most is not None:
            likely[likely > 2 * most] = -np.inf
        _, s = scored(rows[np.argpartition(-likely, 2 * k)[: 2 * k]])
        if len(s) >= k:
            rows = rows[high[rows] >= np.partition(s, -k)[-k]]
    rows, s = scored(rows)
    if len(s) > k:
        keep = s >= np.partition(s, -k)[-k]
        rows, s = rows[keep], s[keep]
    return rows, s


def prepared(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """(row_, vec_id, label, v) of the rows that take part, components as floor(scale * x), written to the shared folder."""
    usable = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= LARGEST))
    return materialize(vectors.filter(usable).select(
        F.monotonically_increasing_id().alias("row_"), F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("int")).alias("v")))


def build_index(rows: DataFrame, members: int) -> DataFrame:
    """A row for each label and vector: its codes, alignments and lengths, and the first ``members`` rows that have it."""
    order = [F.col("vec_id").asc_nulls_last(), "row_"]
    first = rows.withColumn("place", F.row_number().over(W.partitionBy("label", "v").orderBy(*order))).filter(F.col("place") <= members)
    distinct = first.groupBy("label", "v").agg(F.array_sort(F.collect_list(F.struct("place", "vec_id", "row_"))).alias("m"))
    flat = distinct.select("label", "v", F.size("v").alias("d"), F.transform("m", lambda m: F.coalesce(m.vec_id, F.lit(0).cast("long"))).alias("ids"),
                           F.transform("m", lambda m: m.vec_id.isNull()).alias("none"), F.transform("m", lambda m: m.row_).alias("rows"))

    def coded(batches):
        for batch in batches:
            for _, part in batch.groupby("d"):
                codes, aligned, known, left = encode(np.stack(part["v"]).astype(np.int64))
                yield part.assign(codes=[c.tobytes() for c in codes], aligned=list(aligned), coded=known, rest=left)

    return materialize(flat.mapInPandas(coded, "label long, v array<int>, d int, ids array<long>, none array<boolean>, rows array<long>, codes binary, aligned array<double>, coded double, rest double"))


def _parts(n: int, size: int) -> int:
    return max(1, -(-n // size))


def _tiles(index: DataFrame, anchors: DataFrame, search, schema: str) -> DataFrame:
    """``search(index rows, anchors)`` over tiles in which each index row meets each anchor of its length once."""
    blocks, groups = _parts(index.count(), TILE_ROWS), _parts(anchors.count(), TILE_ANCHORS)
    left = index.withColumns({"block": F.pmod(F.xxhash64(F.element_at("rows", 1)), F.lit(blocks)), "group": F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))})
    right = anchors.withColumns({"d": F.size("v"), "group": F.pmod(F.xxhash64("row_"), F.lit(groups)).cast("int"), "block": F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))})
    key = ["d", "group", "block"]

    def tile(index: pd.DataFrame, anchors: pd.DataFrame) -> pd.DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        found = list(search(index, anchors)) if len(index) and len(anchors) else []
        if not found:
            return pd.DataFrame(columns=names)
        many = [len(f["row_"]) for f in found]
        out = {c: np.concatenate([f[c] for f in found]) if c in ("vec_id", "none", "row_", "score") else np.repeat([f[c] for f in found], many) for c in found[0]}
        return pd.DataFrame(out | {"vec_id": pd.arrays.IntegerArray(out["vec_id"], out.pop("none"))})[names]

    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(tile, schema)


def _index_arrays(index: pd.DataFrame) -> tuple:
    codes = np.frombuffer(b"".join(index["codes"]), np.uint64).reshape(len(index), CODES, -1)
    return np.stack(index["v"]).astype(np.int64), (codes, np.stack(index["aligned"]), index["coded"].to_numpy(), index["rest"].to_numpy())


class Members:
    """The rows that index rows stand for, flat."""

    def __init__(self, index: pd.DataFrame):
        self.many = index["rows"].map(len).to_numpy()
        self.start = np.cumsum(self.many) - self.many
        self.none = np.concatenate([np.asarray(x, bool) for x in index["none"]])
        self.ids = np.concatenate([np.asarray(x, np.int64) for x in index["ids"]])
        self.rows = np.concatenate([np.asarray(x, np.int64) for x in index["rows"]])

    def first(self, at: np.ndarray, scores: np.ndarray, k: int, not_row: int = -1, **more) -> dict:
        """The first k members of index rows ``at``: vec_id, none (is it null), row_, score, and ``more`` that holds for all."""
        many = self.many[at]
        flat = np.repeat(self.start[at] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        scores = np.repeat(scores, many)
        if not_row >= 0:
            keep = self.rows[flat] != not_row
            flat, scores = flat[keep], scores[keep]
        order = np.lexsort((self.rows[flat], self.ids[flat], self.none[flat], -scores))[:k]
        flat = flat[order]
        return {"vec_id": self.ids[flat], "none": self.none[flat], "row_": self.rows[flat], "score": scores[order]} | more


def _positives(k: int):
    def search(index, anchors):
        index = index.sort_values("label", kind="stable").reset_index(drop=True)
        v, arrays = _index_arrays(index)
        labels, members = index["label"].to_numpy(), Members(index)
        for label, own in anchors.groupby("label"):
            lo, hi = np.searchsorted(labels, [label, label + 1])
            if lo == hi:
                continue
            a = Anchors(np.stack(own["v"]).astype(np.int64))
            step = max(1, PAIRS // (hi - lo))
            for start in range(0, len(own), step):
                which = slice(start, min(start + step, len(own)))
                e, b = intervals(*(x[lo:hi] for x in arrays), a, which)
                low, high = (e - b).T.copy(), (e + b).T.copy()
                for j, row in enumerate(own["row_"].iloc[which]):
                    at, s = best(low[j], high[j], np.arange(hi - lo), Scores(v[lo:hi], a.v[start + j]), k + 1)
                    yield members.first(at + lo, s, k, row, anchor_row=row)
    return search


def _negatives(k: int):
    def search(index, anchors):
        v, arrays = _index_arrays(index)
        labels, members = index["label"].to_numpy(), Members(index)
        a = Anchors(np.stack(anchors["v"]).astype(np.int64))
        step = max(1, PAIRS // len(index))
        for start in range(0, len(anchors), step):
            which = slice(start, min(start + step, len(anchors)))
            e, b = intervals(*arrays, a, which)
            low, high = (e - b).T.copy(), (e + b).T.copy()
            for j, anchor in enumerate(anchors.iloc[which].itertuples()):
                other, scores = np.flatnonzero(labels != anchor.label), Scores(v, a.v[start + j])
                for place, least, most in zip(anchor.places, anchor.least, anchor.most):
                    at, s = best(low[j], high[j], other, scores, k, least, most)
                    yield members.first(at, s, k, anchor_row=anchor.row_, place=place)
    return search


def mine(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """For each anchor and each of its first ``positives`` rows of the same label, the first ``negatives`` rows of other labels
    whose score is from low % to high % of the positive's: anchor_id, positive_id, rank, negative_id and both scores.

    ``vectors`` has vec_id, label and embedding; ``is_anchor`` is a condition on vec_id."""
    rows = prepared(vectors, scale)
    index = build_index(rows, max(positives + 1, negatives))
    anchors = materialize(rows.filter(is_anchor & F.col("vec_id").isNotNull()))
    order = [F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "row_"]
    found = _tiles(index, anchors, _positives(positives), "anchor_row long, vec_id long, row_ long, score long")
    near = materialize(found.withColumn("place", F.row_number().over(W.partitionBy("anchor_row").orderBy(*order))).filter(F.col("place") <= positives)
                       .select("anchor_row", "place", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")))
    windows = near.filter("positive_score >= 0").groupBy(F.col("anchor_row").alias("row_")).agg(F.array_sort(F.collect_list(F.struct("place", "positive_score"))).alias("p"))
    asking = materialize(anchors.join(windows, "row_").select("row_", "label", "v", F.transform("p", lambda p: p.place).alias("places"),
                         F.transform("p", lambda p: F.ceil(p.positive_score * low / 100)).alias("least"), F.transform("p", lambda p: F.floor(p.positive_score * high / 100)).alias("most")))
    hits = _tiles(index, asking, _negatives(negatives), "anchor_row long, place int, vec_id long, row_ long, score long")
    ranked = hits.withColumn("rank", F.row_number().over(W.partitionBy("anchor_row", "place").orderBy(*order))).filter(F.col("rank") <= negatives)
    return (ranked.select("anchor_row", "place", "rank", F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
            .join(near, ["anchor_row", "place"]).join(anchors.select(F.col("row_").alias("anchor_row"), F.col("vec_id").alias("anchor_id")), "anchor_row")
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


def op11(spark, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings").withColumn("label", label), F.col("vec_id") % 100 == 0)


SQL = """
WITH u AS (SELECT row_number() OVER () AS row_, vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x) OR abs(x) > 1048576]) = 0),
s AS (SELECT a.row_ AS a, a.vec_id AS anchor_id, b.row_ AS b, b.vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
      FROM u a JOIN u b ON a.vec_id % 100 = 0 AND a.row_ <> b.row_),
p AS (SELECT a, anchor_id, b, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, vec_id NULLS LAST, b) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.a, p.b ORDER BY score DESC, vec_id NULLS LAST, s.b) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
