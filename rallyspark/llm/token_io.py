"""Token-id output: documents tokenized, written as coded id files in doc_id order, and read back.

File format (little-endian): the magic, the blocks of range_coder (its model, then the coded ones) back to back, the
block lengths (u32), the documents' ids (i64), a null flag each (u8) and id counts (u64), then a foot with the three counts
and the magic. Files hold whole documents; any coded block, and so any run of ids, can be decoded with the model alone.

Defined results: null text counts as empty and has its end id only; null doc_ids come first; repeated doc_ids are
documents of their own, in the order of a hash of their texts; an empty table gives no files; extra columns are
ignored. A text is tokenized whole, whatever its length.
"""

from __future__ import annotations

import functools
import itertools
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import range_coder
from .common import materialize, shared_dir, table

MAGIC, FOOT = b"RSIDS\x001\n", np.dtype([("blocks", "<u8"), ("docs", "<u8"), ("ids", "<u8")])
END_ID = 0
#: A file is closed at so many ids or soon after: a writing task holds them (2 bytes each) and their coded form.
FILE_IDS = 4_000_000
#: Pieces that a worker remembers (some 200 bytes each), and bytes of text that it cuts at once.
CACHE_PIECES, SLICE_BYTES = 1_200_000, 4 << 20
#: Texts of these characters only are cut into pieces here; their classes are the same in every Unicode version.
_ASCII = bytes([9, 10, 13, *range(32, 127)])
_LATIN = re.compile(rb"(?:\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xbf]|\xc5[\x80-\xbe])*+")
#: A space between white space, or between white space and the end, doesn't start a word.
_RUN = re.compile(rb"[\t\n\r ] (?:[\t\n\r ]|\Z)")
_PAIRS = b"  ", b"\n ", b"\t ", b"\r "
#: Starts each text, and what follows without a space, so that a piece with no space before it is remembered as another one.
_HEAD = b"\0"


#: Letters and digits of such texts, and signs but the apostrophe, by byte.
_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_SIGN = ~_WORD & np.array([c > 32 and c != 39 for c in range(256)])


class Tokenize:
    """Ids of whole texts by the tokenizers library; pieces of plain texts are encoded once and remembered.

    A piece is a space and what follows up to the next one; a sign (but the apostrophe) after a letter or
    digit starts another one. Merges never cross the vocabulary's word boundaries, and such a vocabulary starts a word there and
    at every space that isn't inside a run of white space, so a text's ids are its pieces' ids in a row. The file must say that it
    cuts words so. Texts with other characters, with the string of a special token or with spaces inside runs of white space
    go through the library whole."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        rule = json.loads(self.library.to_str())
        before = rule["pre_tokenizer"] or {}
        self.cuts = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not rule["normalizer"] and rule["model"]["type"] == "BPE"
        # Whether an id starts with a space: in pieces in a row, only their first ids do.
        self.starts = np.array([(self.library.id_to_token(i) or "").startswith("Ġ") for i in range(1 << 16)])
        self.seen: dict[bytes, int] = {}
        self.used, self.pool = 0, np.zeros(1 << 20, np.uint16)
        self.from_, self.size, self.uses = (np.zeros(CACHE_PIECES, np.int64) for _ in range(3))

    def forget(self) -> None:
        """Forgets the pieces used once, and all but the most used if half the room is not enough for the others."""
        n = len(self.seen)
        kept = np.flatnonzero(self.uses[:n] > 1)
        if len(kept) > CACHE_PIECES // 2:
            kept = np.sort(kept[np.argsort(-self.uses[kept], kind="stable")[: CACHE_PIECES // 2]])
        pieces, size = list(self.seen), self.size[kept]
        upto = np.cumsum(size)
        pool = self.pool[np.repeat(self.from_[kept] - upto + size, size) + np.arange(size.sum())]
        self.seen, self.used = {}, len(pool)
        self.seen.update((pieces[i], k) for k, i in enumerate(kept.tolist()))
        self.pool[: len(pool)], self.from_[: len(kept)], self.size[: len(kept)] = pool, upto - size, size
        self.uses[: len(kept)] = self.uses[kept] // 2
        self.uses[len(kept):] = 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint16)

    def remember(self, pieces: list[bytes]) -> None:
        """Numbers new pieces and remembers their ids."""
        # Pieces in a row are encoded at once; those that white space ends, and those without a space, one by one.
        row = np.fromiter([p > _HEAD and p[0] > 0 and p[-1] > 32 for p in pieces], bool, len(pieces))
        flat, sizes = np.zeros(0, np.uint16), np.zeros(len(pieces), np.int64)
        if row.any():
            flat = np.array(self.library.encode_batch_fast([" " + b" ".join(itertools.compress(pieces, row.tolist())).decode()], add_special_tokens=False)[0].ids, np.uint16)
            sizes[row] = np.diff(np.append(np.flatnonzero(self.starts[flat]), len(flat)))
        one = np.flatnonzero(~row)
        texts = [pieces[i][1:].decode() if pieces[i][:1] == _HEAD else " " + pieces[i].decode() for i in one.tolist()]
        ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        sizes[one] = np.fromiter(map(len, ids), np.int64, len(ids))
        n, k = self.used + int(sizes.sum()), len(self.seen)
        while n > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used: n] = np.concatenate([flat, *[np.array(x, np.uint16) for x in ids]])
        order = np.append(np.flatnonzero(row), one)  # as their ids stand in the pool
        self.from_[k + order] = self.used + np.cumsum(sizes[order]) - sizes[order]
        self.size[k: k + len(pieces)], self.used = sizes, n
        self.seen.update(zip(pieces, range(k, k + len(pieces))))

    def __call__(self, texts: list[str | None]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        plain: list[int] = []
        held: list[bytes] = []
        waiting = 0

        def cut() -> None:
            nonlocal waiting
            for i, ids in zip(plain, self.plain(held)):
                out[i] = ids
            plain.clear()
            held.clear()
            waiting = 0

        for i, text in enumerate(texts):
            text = text or ""
            body = text.encode()
            if self.cuts and _LATIN.fullmatch(body.translate(None, _ASCII)) and not (any(s in body for s in _PAIRS) and _RUN.search(body)) and not any(s in text for s in self.special):
                plain.append(i)
                held.append(_HEAD + body)
                waiting += len(body)
                if waiting >= SLICE_BYTES:
                    cut()
            else:
                out[i] = self.whole(text)
        if held:
            cut()
        return out

    def plain(self, texts: list[bytes]) -> list[np.ndarray]:
        """Ids of plain texts, each with _HEAD before it."""
        # Equal pieces of a slice meet in Arrow first.
        body = b" ".join(texts)
        data = np.frombuffer(body, np.uint8)
        ends = np.flatnonzero(_SIGN[data[1:]] & _WORD[data[:-1]]) + 1
        body = np.insert(data, np.repeat(ends, 2), np.tile(np.frombuffer(b" " + _HEAD, np.uint8), len(ends))).tobytes()
        cut = pc.split_pattern(pa.array([body], pa.large_binary()), " ").values.dictionary_encode()
        pieces, which = cut.dictionary.to_numpy(zero_copy_only=False).tolist(), cut.indices.to_numpy()
        if len(pieces) > CACHE_PIECES // 2:
            return [self.whole(t[1:].decode()) for t in texts]
        if len(self.seen) + len(pieces) > CACHE_PIECES:
            self.forget()
        place = np.fromiter(map(self.seen.get, pieces, itertools.repeat(-1)), np.int64, len(pieces))
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = len(self.seen) + np.arange(len(new))
            self.remember([pieces[i] for i in new.tolist()])
        self.uses[place] += np.bincount(which, minlength=len(pieces))
        place = place[which]
        n = self.size[place]
        upto = np.cumsum(n)
        ids = self.pool[np.repeat(self.from_[place] - upto + n, n) + np.arange(upto[-1])]
        cuts = np.searchsorted(ends, np.cumsum([len(t) + 1 for t in texts]))
        last = np.cumsum([t.count(b" ") + 1 for t in texts]) + cuts - 1
        return np.split(ids, upto[last[:-1]])


@functools.cache
def tokenizer_of(path: str) -> Tokenize:
    """A worker's tokenizer: what it remembers serves all tasks that it runs."""
    return Tokenize(path)


def pack_file(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    blocks = range_coder.encode(np.concatenate(ids) if ids else np.zeros(0, np.int64))
    counts = np.array([len(x) for x in ids], "<u8")
    foot = np.array([(len(blocks), len(ids), counts.sum())], FOOT)
    return b"".join([MAGIC, *blocks, np.array([len(b) for b in blocks], "<u4").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
                     np.array([d is None for d in doc_ids], "u1").tobytes(), counts.tobytes(), foot.tobytes(), MAGIC])


def unpack_file(body: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    if body[:8] != MAGIC or body[-8:] != MAGIC:
        raise ValueError("not an id file")
    foot = np.frombuffer(body[-8 - FOOT.itemsize: -8], FOOT)[0]
    n, docs = int(foot["blocks"]), int(foot["docs"])
    at = len(body) - 8 - FOOT.itemsize - 17 * docs - 4 * n
    lengths = np.frombuffer(body, "<u4", n, at)
    names, nulls = np.frombuffer(body, "<i8", docs, at + 4 * n), np.frombuffer(body, "u1", docs, at + 4 * n + 8 * docs)
    counts = np.frombuffer(body, "<u8", docs, at + 4 * n + 9 * docs).astype(np.int64)
    ends = 8 + np.cumsum(lengths, dtype=np.int64)
    ids = range_coder.decode([body[e - size: e] for e, size in zip(ends.tolist(), lengths.tolist())])
    if len(ids) != counts.sum():
        raise ValueError("an id file is short of ids")
    return [None if null else int(d) for d, null in zip(names, nulls)], np.split(ids, np.cumsum(counts)[:-1]) if docs else []


def write_ids(docs: DataFrame, folder: str, tokenizer: str, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes documents in ascending doc_id order; returns the manifest (part, seq, path, docs, ids, bytes)."""
    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenize, names, ids, held, seq, part = tokenizer_of(tokenizer), [], [], 0, 0, None

        def close() -> pa.RecordBatch:
            nonlocal names, ids, held, seq
            path = f"{folder}/{uuid.uuid4().hex}.ids"
            store, at = fs.FileSystem.from_uri(path)
            store.create_dir(at.rpartition("/")[0], recursive=True)
            body = pack_file(names, ids)
            with store.open_output_stream(at, compression=None) as out:
                out.write(body)
            made = pa.RecordBatch.from_pydict({"part": [part], "seq": [seq], "path": [path], "docs": [len(names)], "ids": [held], "bytes": [len(body)]},
                                              schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), *[(c, pa.int64()) for c in ("docs", "ids", "bytes")]]))
            names, ids, held, seq = [], [], 0, seq + 1
            return made

        for batch in it:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                part = rows.column(2)[0].as_py()
                for name, of_text in zip(rows.column(0).to_pylist(), tokenize(rows.column(1).to_pylist())):
                    names.append(name)
                    ids.append(np.append(of_text, np.uint16(END_ID)))
                    held += len(ids[-1])
                    if held >= file_ids:
                        yield close()
        if names:
            yield close()

    # The hash and the row number split what null or repeated doc_ids would put into one task.
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64(F.col("text").cast("string")).alias("h"), F.monotonically_increasing_id().alias("row"))
    order = [F.asc_nulls_first("doc_id"), F.col("h"), F.col("row")]
    ordered = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(ordered.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(write, "part int, seq int, path string, docs long, ids long, bytes long"))


def read_ids(manifest: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per writing task
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("n")).select(F.col("part").alias("of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_from"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    files = materialize(manifest.withColumn("file_from", F.coalesce(F.sum("ids").over(within), F.lit(0)))
                        .join(parts, F.col("part") == F.col("of")).select("path", (F.col("part_from") + F.col("file_from")).alias("from")))

    def read(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                store, at = fs.FileSystem.from_uri(row["path"])
                with store.open_input_file(at) as f:
                    names, ids = unpack_file(f.read())
                sizes = np.array([len(x) for x in ids], np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array(names, pa.int64()), pa.array(row["from"] + np.cumsum(sizes) - sizes), pa.array(sizes),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.repartition(max(1, files.count()), "path").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    return read_ids(write_ids(docs, shared_dir(spark), tokenizer))


def op6(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(spark, table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
