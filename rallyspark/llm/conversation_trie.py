"""The prefix trie of conversations by truncation peeling.

Every node is a distinct sequence of first turns, named by a chained digest. From the greatest depth down, the conversations
that end at a depth are merged with the nodes that survive from below; then each node's last turn is stripped and nodes that
have become equal are regrouped, their totals added. A node is complete when its depth is reached, so one descent finds all
nodes and all totals.

A level is one shuffle, added up before it, so hot prefixes meet as one row per task. Deep levels hold ever fewer rows, and most
belong to small families: a prefix of 1, 2, 4, 8 ... turns (or none) under which at most ``FAMILY`` turns lie is peeled
within one task, all levels at once and many families together, and goes on as one surviving node. Levels of the whole table are left only above the
families, where more than ``FAMILY`` turns share a prefix; their number grows with the length of what so many share, not with
that of the longest conversation. Equal conversations are merged first; their ids are hashed as a sorted stream.

Defined results: turns are ordered by turn (null first), ties by their digest; null role or text is empty; rows without
conv_id take no part; repeated rows stay; a table without conversations has no nodes. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, table

#: Most turns that a family may have to be peeled in one task.
FAMILY = 20_000
ROOT, EMPTY = b"\0" * 16, hashlib.sha256(b"").hexdigest()
NODE = "node binary, parent binary, depth int, chars long, conv_id long, n_convs long, n_children long, n_leaves long, saved long, ends_sha256 string"


def numbered_turns(turns: DataFrame) -> DataFrame:
    """(conv_id, place, digest, chars) of each turn: its place in the conversation, from 1. Texts end here."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.length(text).cast("long").alias("chars"))
    return rows.select("conv_id", F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "digest")).alias("place"), "digest", "chars")


def rebuilt(turns: DataFrame, base: Column, head: Column, longest_head: int) -> DataFrame:
    """(conv_id, place, digest, chars) of rebuilt conversations: the first ``head`` turns of conversation ``base``, then a
    conversation's own turns after its first ``head``; and for each a row of place 0. ``base`` and ``head`` are made from
    conv_id; ``head`` is at most ``longest_head``. ``turns`` is numbered_turns()."""
    own = turns.withColumn("head", head)
    convs = turns.filter("place = 1").select("conv_id", base.alias("base"), head.alias("head"))
    lent = turns.filter(F.col("place") <= longest_head).join(convs.select(F.col("base").alias("conv_id")).distinct(), "conv_id", "left_semi").select(F.col("conv_id").alias("base"), "place", "digest", "chars")
    marks = convs.select("conv_id", F.lit(0).alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    borrowed = convs.join(lent, "base").filter(F.col("place") <= F.col("head")).select("conv_id", "place", "digest", "chars")
    return marks.unionByName(borrowed).unionByName(own.filter(F.col("place") > F.col("head")).drop("head"))


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, chars, ends) of each prefix of each conversation, the empty one included. ``node`` is
    the digest of its parent and its last turn. Rows stream through the task in order; none are gathered."""
    def chain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last row, until it is known whether its conversation goes on
        for batch in batches:
            out = []
            for conv, digest, chars in zip(batch["conv_id"].tolist(), batch["digest"].tolist(), batch["chars"].tolist()):
                goes_on = held is not None and held[0] == conv
                if held is not None:
                    out.append((*held, not goes_on))
                held = (conv, held[1] + 1, hashlib.md5(held[2] + bytes(digest)).digest(), held[2], chars) if goes_on else (conv, 0, ROOT, None, 0)
            yield pd.DataFrame(out, columns=["conv_id", "depth", "node", "parent", "chars", "ends"])
        if held is not None:
            yield pd.DataFrame([(*held, True)], columns=["conv_id", "depth", "node", "parent", "chars", "ends"])

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "place").select("conv_id", "digest", "chars")
    return materialize(ordered.mapInPandas(chain, "conv_id long, depth int, node binary, parent binary, chars long, ends boolean"))


def ended(paths: DataFrame) -> DataFrame:
    """(node, first_id, n, depth, ends_sha256) of each node at which conversations end. Ids stream in order through the hash."""
    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now = None
        for batch in batches:
            out = []
            for node, conv, depth in zip(batch["node"].tolist(), batch["conv_id"].tolist(), batch["depth"].tolist()):
                if now is not None and now[0] == node:
                    now[2] += 1
                    sha.update(b",%d" % conv)
                    continue
                if now is not None:
                    out.append((*now, sha.hexdigest()))
                now, sha = [node, conv, 1, depth], hashlib.sha256(b"%d" % conv)
            yield pd.DataFrame(out, columns=["node", "first_id", "n", "depth", "ends_sha256"])
        if now is not None:
            yield pd.DataFrame([(*now, sha.hexdigest())], columns=["node", "first_id", "n", "depth", "ends_sha256"])

    ends = paths.filter("ends").select("node", "conv_id", "depth").repartition("node").sortWithinPartitions("node", "conv_id")
    return materialize(ends.mapInPandas(hashed, "node binary, first_id long, n long, depth int, ends_sha256 string"))


def families(paths: DataFrame, family: int) -> DataFrame:
    """(conv_id, cut): the least depth of 0, 1, 2, 4 ... at which a conversation's prefix has at most ``family`` turns below it.
    ``paths`` has a row per prefix of one conversation of each kind, and ``total``, its length."""
    at = paths.filter(F.expr("(depth & (depth - 1)) = 0")).select("conv_id", "depth", "node", (F.col("total") - F.col("depth") + 1).alias("below"))
    small = at.groupBy("node").agg(F.sum("below").alias("turns")).filter(F.col("turns") <= family)
    return at.join(small, "node", "left_semi").groupBy("conv_id").agg(F.min("depth").alias("cut"))


def peel(rows: pd.DataFrame) -> pd.DataFrame:
    """All nodes of the families in ``rows`` (their prefixes from the depth ``cut`` on); is_top marks those of that depth.

    Families have no prefix in common, so many are peeled at once, each as far as it goes."""
    levels: dict[int, list] = {}
    for r in zip(*(rows[c].tolist() for c in ("depth", "node", "parent", "chars", "cut", "ends", "conv_id", "n", "ends_sha256"))):
        levels.setdefault(r[0], []).append(r)
    done, kept = [], {}
    for depth in sorted(levels, reverse=True):
        here: dict[bytes, list] = {}  # node: [parent, chars, cut, conv_id, n_convs, n_children, n_leaves, saved, ends_sha256]
        for _, node, parent, chars, cut, ends, conv, n, sha in levels[depth]:
            now = here.setdefault(node, [parent, chars, cut, None, 0, 0, 0, 0, EMPTY])
            if ends:  # newly ended conversations
                now[3], now[4], now[8] = conv, n, sha
        for parent, _, cut, conv, n_convs, _, n_leaves, saved, _ in kept.values():
            if cut > depth:  # a family's top goes on elsewhere
                continue
            now = here[parent]  # a survivor whose last turn is stripped
            now[3] = conv if now[3] is None else min(now[3], conv)
            for k, more in ((4, n_convs), (5, 1), (6, n_leaves), (7, saved)):
                now[k] += more
        for node, now in here.items():
            now[6] = now[6] or 1
            now[7] += (now[4] - 1) * now[1]
            done.append((node, now[0], depth, now[1], *now[3:], depth == now[2]))
        kept = here
    return pd.DataFrame(done, columns=[c.split()[0] for c in (NODE + ", is_top boolean").split(", ")])


def peel_level(ends: DataFrame, children: DataFrame | None, depth: int) -> DataFrame:
    """The complete nodes of one depth: prefixes of it with the conversations that end there, merged with the nodes of the next
    depth, stripped of their last turn."""
    null = lambda kind: F.lit(None).cast(kind)
    zero = F.lit(0).cast("long")
    parts = ends.select("node", "parent", "chars", F.when(F.col("ends"), F.col("conv_id")).alias("conv_id"), F.when(F.col("ends"), F.col("n")).otherwise(zero).alias("n_convs"),
                        zero.alias("n_children"), zero.alias("n_leaves"), zero.alias("saved"), F.when(F.col("ends"), F.col("ends_sha256")).alias("ends_sha256"))
    if children is not None:
        parts = parts.unionByName(children.select(F.col("parent").alias("node"), null("binary").alias("parent"), null("long").alias("chars"), "conv_id", "n_convs",
                                                  F.lit(1).cast("long").alias("n_children"), "n_leaves", "saved", null("string").alias("ends_sha256")))
    sums = [F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved")]
    whole = parts.groupBy("node").agg(F.max("parent").alias("parent"), F.max("chars").alias("chars"), F.min("conv_id").alias("conv_id"), *sums, F.max("ends_sha256").alias("ends_sha256"))
    return whole.select("node", "parent", F.lit(depth).alias("depth"), "chars", "conv_id", "n_convs", "n_children", F.greatest("n_leaves", F.lit(1)).alias("n_leaves"),
                        (F.col("saved") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved"), F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"))


def trie(rows: DataFrame, family: int = FAMILY) -> DataFrame:
    """All nodes of the trie of the conversations ``rows(conv_id, place, digest, chars)``, which have a row of place 0 each:
    conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = prefixes(rows)
    kinds = ended(paths)
    one = kinds.select(F.col("first_id").alias("conv_id"), "n", F.col("depth").alias("total"), "ends_sha256")
    paths = materialize(paths.join(one, "conv_id"))  # equal conversations are one from here on
    paths = materialize(paths.join(families(paths, family), "conv_id", "left"))
    own = paths.filter("depth >= cut").join(paths.filter("depth = cut").select("conv_id", F.col("node").alias("top")), "conv_id")
    columns = ["node", "parent", "depth", "chars", "conv_id", "ends", "n", "ends_sha256"]
    buckets = max(1, -(-paths.count() // family))  # families are peeled in batches of about so many turns
    local = materialize(own.select(F.pmod(F.xxhash64("top"), F.lit(buckets)).alias("bucket"), "cut", *columns).groupBy("bucket").applyInPandas(peel, NODE + ", is_top boolean"))
    survivors = local.filter("is_top").drop("is_top")
    above = paths.filter("cut is null or depth < cut").select(*columns)
    top = above.agg(F.max("depth")).first()[0]
    levels, children = [], None
    for depth in range(-1 if top is None else top, -1, -1):
        here = survivors.filter(F.col("depth") == depth + 1)
        children = materialize(peel_level(above.filter(F.col("depth") == depth), here if children is None else children.unionByName(here), depth))
        levels.append(children)
    shared = survivors
    for level in levels:
        shared = shared.unionByName(level)
    # Within a family a node's parent is at hand; a family's top and the nodes above find theirs by name.
    names = local.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    for level in levels:
        names = names.unionByName(level.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id")))
    nodes = shared.unionByName(local.filter("not is_top").drop("is_top")).join(names, "parent", "left")
    return nodes.select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), "ends_sha256")


def op13(spark, sf_dir: str) -> DataFrame:
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    turns = materialize(numbered_turns(table(spark, sf_dir, "conversations")))
    return trie(rebuilt(turns, F.col("conv_id") - F.col("conv_id") % 100, head, 5))


SQL = """
WITH o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base,
      xor(list_reduce(list_prepend(4294967295, [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(conv_id AS VARCHAR), '')]),
          lambda r, b: list_reduce(list_prepend(xor(r, b), [CAST(i AS BIGINT) FOR i IN range(8)]), lambda s, i: CASE WHEN s % 2 = 1 THEN xor(s // 2, 3988292384) ELSE s // 2 END)), 4294967295) % 6 AS head
      FROM (SELECT DISTINCT conv_id FROM o)),
r AS (SELECT c.conv_id, o.place, role, text FROM c JOIN o ON o.conv_id = base AND place <= head UNION ALL SELECT o.conv_id, o.place, role, text FROM o JOIN c USING (conv_id) WHERE place > head),
n AS (SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars, list(sha256(length(role) || ':' || role || text)) OVER (PARTITION BY conv_id ORDER BY place) AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
p AS (SELECT conv_id, depth, chars, path FROM n UNION ALL SELECT conv_id, 0, 0, CAST([] AS VARCHAR[]) FROM c),
e AS (SELECT conv_id, max(depth) AS last FROM p GROUP BY conv_id),
m AS (SELECT path, any_value(depth) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE depth = last), '')) AS ends_sha256
      FROM p JOIN e USING (conv_id) GROUP BY path),
k AS (SELECT path[:-2] AS path, count(*) AS n_children FROM m WHERE depth > 0 GROUP BY 1),
u AS (SELECT path[:i] AS path, m.path AS below, (n_convs - 1) * chars AS saved FROM m, LATERAL (SELECT unnest(range(depth + 1)) AS i)),
s AS (SELECT u.path, count(*) FILTER (WHERE k.path IS NULL) AS n_leaves, CAST(sum(saved) AS BIGINT) AS saved_tokens FROM u LEFT JOIN k ON k.path = below GROUP BY u.path)
SELECT m.conv_id, m.depth, q.conv_id AS parent_conv_id, m.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, m.ends_sha256
FROM m JOIN s USING (path) LEFT JOIN k USING (path) LEFT JOIN m q ON m.depth > 0 AND q.path = m.path[:-2]
"""
