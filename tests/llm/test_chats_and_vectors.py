"""Hard negatives, chat formatting and the conversation trie: brute force, round trips and odd inputs."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rallyspark.llm import chat_format, conversation_trie, hard_negatives

# ---- 11 hard negatives


@pytest.mark.parametrize("d", [0, 1, 3, 64, 100])
def test_intervals_hold_every_score(d):
    rng = np.random.default_rng(d)
    v, q = rng.integers(-300, 300, (200, d)), rng.integers(-300, 300, (30, d))
    v[:3], q[:2] = 0, 0
    v[3:5] = 7
    a = hard_negatives.Anchors(q)
    estimate, bound = hard_negatives.intervals(*hard_negatives.encode(v), a, slice(0, 30))
    assert (np.abs(v @ q.T - estimate) <= bound).all()
    if d >= 64:  # and tell something: most of a vector's length is in its codes
        assert np.median(bound) < 0.35 * np.median(np.linalg.norm(v, axis=1)) * np.median(np.linalg.norm(q, axis=1))


def brute_negatives(rows):
    usable = [(i, label, [math.floor(256 * x) for x in e]) for i, label, e in rows if label is not None and e is not None and all(x is not None and math.isfinite(x) and abs(x) <= 2 ** 20 for x in e)]
    last = lambda i: (i is None, i or 0)
    out = []
    for at, (anchor, label, q) in enumerate(usable):
        if anchor is None or anchor % 10:
            continue
        scored = [(sum(x * y for x, y in zip(v, q)), i, other) for k, (i, other, v) in enumerate(usable) if k != at and len(v) == len(q)]
        scored.sort(key=lambda s: (-s[0], last(s[1])))
        for p, positive, _ in [s for s in scored if s[2] == label][:5]:
            negatives = [s for s in scored if s[2] != label and 30 * p <= 100 * s[0] <= 90 * p][:10]
            out += [(anchor, positive, k + 1, n, p, s) for k, (s, n, _) in enumerate(negatives)]
    return sorted(out, key=repr)


VECTORS = "vec_id long, embedding array<float>, label int, score string"


def test_hard_negatives_match_brute_force(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(i, i % 3, [rng.gauss(0.2, 1) for _ in range(70)]) for i in range(120)]
    same = [0.5] * 70
    rows += [(i, 0, same) for i in range(200, 260)] + [(i, 1, same) for i in range(260, 290)]  # copies under two labels
    rows += [(20, 1, rows[20][2])] * 2  # repeated rows, one of them an anchor's twin
    rows += [(300, None, same), (310, 1, None), (320, 1, same[:-1] + [None]), (330, 1, same[:-1] + [math.nan]), (340, 1, same[:-1] + [math.inf]), (350, 1, same[:-1] + [2.0 ** 21]), (None, 0, same), (None, 2, same)]
    rows += [(360, 1, [1.0, 2.0]), (361, 1, [2.0, 2.0]), (362, 2, [1.0, 1.0]), (370, 4, same), (380, 5, []), (381, 5, []), (382, 6, []), (390, 7, [-1.0]), (391, 7, [1.0]), (392, 8, [0.0])]
    rows = [(i, label, e if e is None else [x if x is None else float(np.float32(x)) for x in e]) for i, label, e in rows]
    frame = spark.createDataFrame([(i, e, label, "x") for i, label, e in rows], VECTORS).repartition(3)
    want = brute_negatives(rows)
    assert len(want) > 200
    for tile_rows, tile_anchors in ((8192, 4096), (40, 3)):
        monkeypatch.setattr(hard_negatives, "TILE_ROWS", tile_rows)
        monkeypatch.setattr(hard_negatives, "TILE_ANCHORS", tile_anchors)
        got = [tuple(r) for r in hard_negatives.mine(frame, F.col("vec_id") % 10 == 0).collect()]
        assert sorted(got, key=repr) == want


def test_hard_negatives_of_nothing(spark):
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS), F.col("vec_id") % 10 == 0).count() == 0
    assert hard_negatives.mine(spark.createDataFrame([(1, [1.0], 1, "x")], VECTORS), F.col("vec_id") % 10 == 0).count() == 0


# ---- 12 chat formatting

TURNS = f"conv_id long, turn long, role string, parts {chat_format.PARTS}, segments int, place string"


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None, parts=None):
    return (kind, text, ref, width, height, seconds, pages) + (() if parts is False else (parts,))


def test_parts_become_numbered_placeholders(spark):
    inner = [part("text", "page <image 9> text", parts=False), part("image", ref="scan.png", width=56, height=29, parts=False)]
    rows = [(1, 0, "user", [part("text", "look: "), part("image", ref="a.png", width=57, height=28), part("audio", ref="b.wav", seconds=2.0), part(None, " done")], 1, "x"),
            (1, 1, "assistant", [part("text", "it says "), part("document", ref="c.pdf", pages=3, parts=inner), part("text", "</turn>\\l")], 1, "x"),
            (1, None, None, [part("video", ref="d.mp4"), part("image"), part("document", ref="e.pdf")], 1, "x"), (2, 0, "assistant", None, 1, "x")]
    chats = chat_format.format_chats(spark.createDataFrame(rows, TURNS))
    by = {r.conv_id: r for r in chats.collect()}
    text = "".join(s.text for s in by[1].segments)
    assert text == ("<turn >\n<file 1><image 2><document 3></turn>\n<turn user>\nlook: <image 4><audio 5> done</turn>\n"
                    "<turn assistant>\nit says <document 6>page \\limage 9> text<image 7></document>\\l/turn>\\sl</turn>\n")
    assert [(a.number, a.turn, a.kind, a.ref, a.tokens) for a in by[1].attachments] == [
        (1, 1, "file", "d.mp4", 0), (2, 1, "image", None, 1), (3, 1, "document", "e.pdf", 256), (4, 2, "image", "a.png", 3), (5, 2, "audio", "b.wav", 25), (6, 3, "document", "c.pdf", 768), (7, 3, "image", "scan.png", 4)]
    assert by[1].expanded_tokens == 1 + 256 + 3 + 25 + 768 + 4 and by[2].expanded_tokens == 0
    back = {r.conv_id: r for r in chat_format.read_chats(chats).collect()}
    assert [(t.role, t.text, t.attachments) for t in back[1].turns] == [("", "", [1, 2, 3]), ("user", "look:  done", [4, 5]), ("assistant", "it says page <image 9> text</turn>\\l", [6, 7])]
    assert back[1].loss_text == "it says page <image 9> text</turn>\\l" and back[1].formatted_chars == len(text)
    assert [(t.role, t.text) for t in back[2].turns] == [("assistant", "")] and back[2].loss_text == ""


def test_any_text_and_role_come_back(spark):
    rng = random.Random(5)
    bits = ["\\", "\\s", "\\l", "\\g", "<turn user>\n", "</turn>", "</turn>\n", "<image 1>", "</document>", ">", "<", "\n", "é😀", "a", "### Assistant:", "<turns>", "$1", " "]
    some = lambda: "".join(rng.choices(bits, k=rng.randint(0, 8)))
    rows = [(c, t, rng.choice(["user", "assistant", some(), None]), rng.choice([some(), some(), None])) for c in range(150) for t in range(rng.randint(1, 5))]
    rows += [(None, 1, "user", "x"), (None, None, "assistant", "y"), (900, 1, "assistant", "same"), (900, 1, "assistant", "same"), (901, 0, "assistant", "long </turn> " * 100_000), (-7, 0, "user", r"\### Assistant: </turn> ok")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("parts", chat_format.text_part(F.col("text")))
    got = {r.conv_id: r for r in chat_format.digests(chat_format.read_chats(chat_format.format_chats(frame))).collect()}
    groups = defaultdict(list)
    for c, t, role, text in rows:
        groups[c].append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        turns.sort()
        loss = "".join(text for *_, role, text in turns if role == "assistant")
        assert got[c].n_turns == len(turns) and got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in turns).encode()).hexdigest()
    assert chat_format.format_chats(frame.limit(0)).count() == 0


# ---- 13 prefix trie

def brute_trie(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(turns, key=lambda x: (*x[:2], hashlib.md5(f"{len(x[2].encode())}:{x[2]}{x[3]}".encode()).digest()))] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = tuple(own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    ends = lambda node: ",".join(map(str, sorted(c for c in members[node] if len(built[c]) == len(node))))
    return sorted((min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends(node).encode()).hexdigest()) for node, m in members.items())


def test_trie_matches_brute_force(spark):
    rng = random.Random(8)
    said = ["", "a", "bb", "é😀", None]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(said)) for c in [*range(0, 40), *range(100, 130), *range(-130, -90), 255] for t in range(rng.choice([1, 2, 3, 5, 9]))]
    chain = [("user", f"turn {i}") for i in range(25)]  # a log in which every prefix of one conversation is a conversation
    rows += [(c, t, *chain[t]) for c in range(500, 525) for t in range(c - 499)] + [(600 + k, t, *chain[t]) for k in range(30) for t in range(25)]
    rows += [(None, 0, "user", "x"), (700, None, "user", "first"), (700, 1, "user", "b"), (700, 1, "user", "a"), (700, 1, "user", "a"), (800, 1, "user", "word " * 50_000)]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, node int").repartition(3)
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6
    want = brute_trie(rows)
    turns = conversation_trie.numbered_turns(frame)
    for family in (20_000, 60, 5):
        got = conversation_trie.trie(conversation_trie.rebuilt(turns, F.col("conv_id") - F.col("conv_id") % 100, head, 5), family)
        assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_trie_of_nothing(spark):
    turns = conversation_trie.numbered_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert conversation_trie.trie(conversation_trie.rebuilt(turns, F.col("conv_id"), F.lit(0), 5)).count() == 0
