"""WARC archives packaged in ZIP files: written by tasks, read back by byte ranges without extraction.

An archive is a ZIP with two stored (uncompressed) members: ``archive/data.warc.gz``, whose records are gzip members
of their own, and ``indexes/index.cdxj``, one line per record with its place. The reader range-reads the end of the
ZIP, parses the end record (ZIP64 where present) and the central directory, finds both stored members through their
local headers, range-reads the index, and hands out runs of neighbouring records; each task then range-reads its runs.

Defined results: null html is an empty payload; null urls are written without a target; of records with equal
payloads of at least ``LEAST`` bytes, those with the smallest page_id are responses and the rest revisit it (null
page_ids come last); repeated rows are records of their own; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table

LEAST = 100
#: An archive is closed at this size: it is what a writing task holds in memory.
ARCHIVE_BYTES = 32 << 20
#: A reading task fetches runs of neighbouring records of about this size at once, and about so many of them.
RUN_BYTES, TASK_RUNS = 4 << 20, 4
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"


# ---- records

def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member: a WARC/1.1 response, or a revisit that carries the digest and length but no payload."""
    revisit = refers_to is not None
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if not revisit:
        block += payload
    head = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"),
            ("WARC-Date", "2024-01-01T00:00:00Z"), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha256:{digest}"),
            ("Content-Length", str(len(block)))]
    if url is not None:
        head.append(("WARC-Target-URI", " ".join(url.split())))
    if revisit:
        head += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")]
    lines = "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "surrogatepass")
    return gzip.compress(b"WARC/1.1\r\n" + lines + b"\r\n" + block + b"\r\n\r\n", 5, mtime=0)


def parse_record(member: bytes) -> dict:
    """Headers and payload of one gzip member; the digest of a response's payload is checked."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    fields = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines[1:])}
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    page = lambda name: int(v) if (v := fields[name][len("<urn:page:"): -1]) else None
    out = {"page_id": page("warc-record-id"), "url": fields.get("warc-target-uri"), "record_type": fields["warc-type"],
           "payload_digest": fields["warc-payload-digest"].removeprefix("sha256:"), "refers_to": None, "payload": None}
    if out["record_type"] == "revisit":
        out["refers_to"] = page("warc-refers-to")
        sizes = [int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        return out | {"payload_bytes": sizes[0]}
    if hashlib.sha256(payload).hexdigest() != out["payload_digest"]:
        raise ValueError(f"payload of page {out['page_id']} does not match its digest")
    return out | {"payload": payload, "payload_bytes": len(payload)}


# ---- ZIP packaging

def package(data: bytes, index: bytes) -> bytes:
    """A ZIP with both members stored."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True) as z:
        for name, body in ((DATA, data), (INDEX, index)):
            z.writestr(zipfile.ZipInfo(name, (2024, 1, 1, 0, 0, 0)), body)
    return out.getvalue()


def _zip64(extra: bytes, wanted: list[int]) -> list[int]:
    """Fields that are all ones, taken in order from the ZIP64 extra field."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            values = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            return [next(values) if v == 0xFFFFFFFF else v for v in wanted]
        at += 4 + size
    return wanted


def stored_members(read, size: int) -> dict[str, tuple[int, int]]:
    """name -> (offset of its bytes, length) for the stored members of a ZIP; ``read(offset, length)`` is a range read."""
    tail_at = max(0, size - 65_557 - 20)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(b"PK\x05\x06")
    if end < 0:
        raise ValueError("no end of central directory: not a ZIP")
    count, length, at = struct.unpack_from("<HII", tail, end + 10)
    locator = end - 20
    if locator >= 0 and tail[locator: locator + 4] == b"PK\x06\x07":
        where = struct.unpack_from("<Q", tail, locator + 8)[0]
        record64 = read(where, 56)
        if record64[:4] != b"PK\x06\x06":
            raise ValueError("damaged ZIP64 end record")
        count, length, at = struct.unpack_from("<QQQ", record64, 32)
    directory, out, p = read(at, length), {}, 0
    for _ in range(count):
        if directory[p: p + 4] != b"PK\x01\x02":
            raise ValueError("damaged central directory")
        method, = struct.unpack_from("<H", directory, p + 10)
        packed, plain = struct.unpack_from("<II", directory, p + 20)
        n_name, n_extra, n_note = struct.unpack_from("<HHH", directory, p + 28)
        header, = struct.unpack_from("<I", directory, p + 42)
        name = directory[p + 46: p + 46 + n_name].decode()
        plain, packed, header = _zip64(directory[p + 46 + n_name: p + 46 + n_name + n_extra], [plain, packed, header])
        if method == 0:
            local = read(header, 30)
            if local[:4] != b"PK\x03\x04":
                raise ValueError("damaged local header")
            out[name] = (header + 30 + sum(struct.unpack_from("<HH", local, 26)), plain)
        p += 46 + n_name + n_extra + n_note
    return out


# ---- Spark jobs

def _open(uri: str):
    """(file system, path) of a URI in the shared folder."""
    return fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes pages(page_id, url, payload, digest, refers_to) and returns the manifest (path, bytes, records).

    A task names its files at random and they count only once its manifest rows are there, so retried and
    speculative tasks leave at most unlisted files.
    """
    def write(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, index, n = bytearray(), [], 0

        def close() -> pa.RecordBatch:
            nonlocal n
            path = f"{folder}/{uuid.uuid4().hex}.wacz"
            store, at = _open(path)
            store.create_dir(at.rpartition("/")[0], recursive=True)
            body = package(bytes(data), "".join(index).encode())
            with store.open_output_stream(at, compression=None) as out:
                out.write(body)
            made = pa.RecordBatch.from_pydict({"path": [path], "bytes": [len(body)], "records": [n]})
            data.clear()
            index.clear()
            n = 0
            return made

        for batch in it:
            for row in batch.to_pylist():
                member = record(row["page_id"], row["url"], row["payload"] or b"", row["digest"], row["refers_to"])
                index.append(f"{row['digest']} {json.dumps({'offset': len(data), 'length': len(member)})}\n")
                data += member
                n += 1
                if len(data) >= archive_bytes:
                    yield close()
        if n:
            yield close()

    return materialize(pages.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, "path string, bytes long, records long"))


def read_archives(manifest: DataFrame, run_bytes: int = RUN_BYTES) -> DataFrame:
    """The records of the archives in ``manifest(path, bytes)``: page_id, url, record_type, payload_bytes,
    payload_digest, refers_to, payload (null for revisits)."""
    def locate(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                store, at = _open(row["path"])
                with store.open_input_file(at) as f:
                    members = stored_members(lambda o, n: f.read_at(n, o), row["bytes"])  # noqa: B023
                    index = f.read_at(members[INDEX][1], members[INDEX][0])
                runs: list[list[int]] = []
                for line in index.decode().splitlines():
                    place = json.loads(line.partition(" ")[2])
                    if not runs or runs[-1][1] + place["length"] > run_bytes:
                        runs.append([members[DATA][0] + place["offset"], 0, []])
                    runs[-1][1] += place["length"]
                    runs[-1][2].append(place["length"])
                yield pa.RecordBatch.from_pydict({"path": [row["path"]] * len(runs), "at": [r[0] for r in runs], "size": [r[1] for r in runs], "lengths": [r[2] for r in runs]},
                                                 schema=pa.schema([("path", pa.string()), ("at", pa.int64()), ("size", pa.int64()), ("lengths", pa.list_(pa.int64()))]))

    types = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]

    def fetch(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for row in batch.to_pylist():
                store, at = _open(row["path"])
                with store.open_input_file(at) as f:
                    body = f.read_at(row["size"], row["at"])
                rows, p = [], 0
                for n in row["lengths"]:
                    rows.append(parse_record(body[p: p + n]))
                    p += n
                    if len(rows) >= 256:
                        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(types))
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(types))

    runs = manifest.select("path", "bytes").mapInArrow(locate, "path string, at long, size long, lengths array<long>")
    tasks = -(-(manifest.agg(F.sum("bytes")).first()[0] or 1) // (TASK_RUNS * run_bytes))
    return runs.repartition(tasks, "path", "at").mapInArrow(  # a number of tasks by bytes: the rows themselves are tiny
        fetch, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary")


def with_revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """(page_id, url, payload, digest, refers_to): refers_to is set where a smaller page_id has the same payload."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    # Only the digests that several pages share are joined back: a small table as a rule, split by AQE where it is not.
    shared = materialize(pages.filter(F.octet_length("html") >= least).select(F.col("page_id").cast("long").alias("page_id"), F.sha2(F.col("html").cast("binary"), 256).alias("digest"))
                         .groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").select("digest", "first_id"))
    return rows.join(shared, "digest", "left").select("page_id", "url", "payload", "digest", F.when((F.col("page_id") > F.col("first_id")) | F.col("page_id").isNull(), F.col("first_id")).alias("refers_to"))


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes ``pages`` as archives in the shared folder and reads their records back."""
    return read_archives(write_archives(with_revisits(pages), shared_dir(spark)))


def op1(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark, table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM h)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= {LEAST} AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN payload_bytes >= {LEAST} AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""
