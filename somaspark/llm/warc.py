"""WARC archives: a writer with identical-payload revisits and a salvage reader.

``mark_revisits`` finds equal payloads by digest, ``write_archives`` writes gzip members (one record
each) to files of bounded size through the file system that the folder's URI names, and
``read_archives`` reads them back by byte ranges. The reader checks every member (gzip CRC, version
line, mandatory fields, lengths, block and payload digests). After a failed check it searches for the next
member or version line that passes, goes on from there and logs the bytes between as a quarantined
gap.

Defined results: a null payload is empty; a null url leaves the target header out; of equal payloads
of at least ``min_bytes`` the record with the largest page_id is the response (all of them, if rows
repeat that id), a null page_id never wins over another; an empty table gives no file and no record;
extra columns are ignored. Files of failed task attempts are never read: the stored manifest names
the files of the attempts that ended well.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, stored, text_or_empty

VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
#: Header fields that every record has by the format's standard.
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
HTTP_LENGTH = re.compile(rb"content-length:[ \t]*([0-9]+)[ \t]*$")
DATE = "2024-01-01T00:00:00Z"
FILE_BYTES, RANGE_BYTES, READ_BYTES, SALTS = 16 << 20, 32 << 20, 4 << 20, 16
HEAD_BYTES = 1 << 16
RECORD = "kind string, path string, at long, length long, reason string, page_id long, record_type string, refers_to long, target_uri string, payload_bytes long, payload_digest string, payload binary"


def mark_revisits(pages: DataFrame, min_bytes: int = 1000) -> DataFrame:
    """page_id, url, payload binary, digest (SHA-1 hex), refers_to (null for responses)."""
    df = pages.select("page_id", "url", F.encode(text_or_empty("html"), "UTF-8").alias("payload"))
    df = df.withColumns({"digest": F.sha1("payload"), "salt": F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")})
    # digests only travel here; a hot payload is counted within each task first and its row copied to all salts
    groups = df.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.max("page_id").alias("first")).where("n > 1")
    groups = groups.select("digest", "first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    df = df.join(groups.hint("shuffle_hash"), ["digest", "salt"], "left")
    return df.select("page_id", "url", "payload", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'none' if page_id is None else page_id}>"


def page_of(rid: str | None) -> int | None:
    tail = (rid or "").rstrip(">").rpartition(":")[2]
    return int(tail) if tail.lstrip("-").isdigit() else None


def sha1_header(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One uncompressed record; a revisit keeps the HTTP head and leaves the payload out."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: {sha1_header(payload)}", f"WARC-Block-Digest: {sha1_header(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 5) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def write_archives(marked: DataFrame, folder: str | None = None, file_bytes: int = FILE_BYTES, compress: bool = True) -> DataFrame:
    """Writes the records and returns the stored manifest: path, bytes, records."""
    spark = marked.sparkSession
    folder = folder or scratch_path(spark, "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        part, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex[:8]
        parts: list[bytes] = []
        size = count = serial = 0

        def flush() -> pa.RecordBatch:
            nonlocal parts, size, count, serial
            path = f"{root}/part-{part:05d}-{serial:04d}-{attempt}.warc" + ".gz" * compress
            with store.open_output_stream(path, compression=None) as out:
                out.write(b"".join(parts))
            row = pa.RecordBatch.from_pydict({"path": [path], "bytes": [size], "records": [count]}, schema=schema)
            parts, size, count, serial = [], 0, 0, serial + 1
            return row

        schema = pa.schema([("path", pa.string()), ("bytes", pa.int64()), ("records", pa.int64())])
        for b in batches:
            for page_id, url, payload, refers_to in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "refers_to")), strict=True):
                raw = record_bytes(page_id, url, payload, refers_to)
                parts.append(member(raw) if compress else raw)
                size, count = size + len(parts[-1]), count + 1
                if size >= file_bytes:
                    yield flush()
        if parts:
            yield flush()

    made = marked.select("page_id", "url", "payload", "refers_to").mapInArrow(write, "path string, bytes long, records long")
    return stored(made.withColumn("folder", F.lit(folder)), "warc-manifest")


def parse_record(data: bytes | memoryview, p: int) -> tuple[str, int, dict]:
    """('ok', next position, record), ('more', the bytes needed or 0, {}) if data ends too soon, or
    ('bad', 0, reason)."""
    bad = lambda why: ("bad", 0, {"reason": why})
    head, size = b"", HEAD_BYTES
    while (end := head.find(b"\r\n\r\n")) < 0:  # further on until the data at hand ends
        if head and len(head) == len(data) - p:
            return "more", 0, {}
        head, size = bytes(data[p : p + size]), 2 * size
        if not head.startswith(b"WARC/1."[: len(head)]):
            return bad("version line")
        if not head:
            return "more", 0, {}
    fields = {}
    for line in head[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.isascii():
            return bad("header")
        fields[name.strip().lower().decode("ascii", "replace")] = value.strip().decode("utf-8", "replace")
    if missing := [name for name in MANDATORY if name not in fields]:
        return bad(f"no {missing[0]}")
    if not re.fullmatch("[0-9]+", fields["content-length"]):
        return bad("length")
    start, size = p + end + 4, int(fields["content-length"])
    if start + size + 4 > len(data):
        return "more", start + size + 4 - p, {}
    block = bytes(data[start : start + size])
    if bytes(data[start + size : start + size + 4]) != b"\r\n\r\n":
        return bad("record end")
    if fields.get("warc-block-digest", sha1_header(block)) != sha1_header(block):
        return bad("block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next((int(m[1]) for m in map(HTTP_LENGTH.match, http.lower().split(b"\r\n")) if m), len(payload))
    kind = fields.get("warc-type", "")
    if kind == "response" and (length != len(payload) or fields.get("warc-payload-digest", sha1_header(payload)) != sha1_header(payload)):
        return bad("payload digest")
    digest = fields.get("warc-payload-digest", "").partition(":")[2]
    try:
        digest = base64.b32decode(digest).hex()
    except ValueError:
        return bad("payload digest")
    return "ok", start + size + 4, {
        "page_id": page_of(fields.get("warc-record-id")), "record_type": kind, "refers_to": page_of(fields.get("warc-refers-to")), "target_uri": fields.get("warc-target-uri"),
        "payload_bytes": length, "payload_digest": digest, "payload": payload if kind == "response" else None,
    }


def parse_member(data: bytes | memoryview, p: int) -> tuple[str, int, list[dict]]:
    """As parse_record, for one gzip member or one plain record at p."""
    if bytes(data[p : p + 1]) == b"W":
        got, after, rec = parse_record(data, p)
        return got, after, [rec]
    if bytes(data[p : p + 3]) != MAGIC[: len(data) - p]:
        return "bad", 0, [{"reason": "no member"}]
    z, out, q = zlib.decompressobj(31), [], p
    try:
        while not z.eof:
            if q >= len(data):
                return "more", 0, []
            out.append(z.decompress(data[q : q + 16384]))
            q += 16384
    except zlib.error:
        return "bad", 0, [{"reason": "gzip"}]
    after, raw, at, recs = min(q, len(data)) - len(z.unused_data), b"".join(out), 0, []
    while at < len(raw):
        got, at, rec = parse_record(raw, at)
        if got != "ok":
            return "bad", 0, [rec or {"reason": "short record"}]
        recs.append(rec)
    return ("ok", after, recs) if recs else ("bad", 0, [{"reason": "empty member"}])


def salvage(f, size: int, lo: int, hi: int) -> Iterator[dict]:
    """Records that start in [lo, hi) of the file f, each with the gap that follows it, if one does.

    A range that begins inside a record skips to the first start that passes all checks; the range
    before it reads that record to its end. A gap belongs to the range of the record before it, the
    file's first one to the first range, so each record and each gap is found once. Of the file no
    more is held than the record at hand and a few blocks."""
    base, data = lo, b""

    def load(until: int) -> bool:
        """Holds the bytes up to ``until``, or a block more; whether there were any."""
        nonlocal data
        held = base + len(data)
        more = min(size, max(until, held + READ_BYTES)) - held
        data += f.read_at(more, held) if more else b""
        return more > 0

    def at(p: int) -> tuple[str, int, list[dict]]:
        """As parse_member, with the position in the file that follows."""
        nonlocal base, data
        if p - base > READ_BYTES:
            base, data = p, data[p - base :]
        while True:
            got, n, recs = parse_member(memoryview(data), p - base)
            if got != "more":
                return got, base + n, recs
            if p + n > size or not load(p + max(n, 2 * (base + len(data) - p))):
                return "bad", 0, [{"reason": "cut off"}]

    def next_start(p: int, stop: int) -> int:
        """The first position in [p, stop) that passes all checks; stop if none does."""
        while p < stop:
            found = [x for x in (data.find(MAGIC, p - base), data.find(b"WARC/1.", p - base)) if x >= 0]
            if found:
                p = base + min(found)
                if p < stop and at(p)[0] == "ok":
                    return p
                p += 1
            else:
                p = max(p, base + len(data) - 6)
                if not load(0):
                    break
        return stop

    stop, good = min(hi, size), False
    p = next_start(lo, stop) if lo else 0
    while p < stop or good and p < size:
        got, after, recs = at(p)
        good = got == "ok"
        if good and p >= stop:
            return
        if good:
            yield from ({"kind": "record", "at": p, "length": after - p, "reason": None, **r} for r in recs)
        else:
            after = next_start(p + 1, size)
            yield {"kind": "gap", "at": p, "length": after - p, "reason": recs[0]["reason"]}
        p = after


def read_archives(manifest: DataFrame, range_bytes: int = RANGE_BYTES, payloads: bool = True, partitions: int | None = None) -> DataFrame:
    """RECORD rows: kind 'record' or 'gap' (path, at, length and reason of quarantined bytes)."""
    spark = manifest.sparkSession
    partitions = partitions or max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranges = manifest.where("bytes > 0").select("folder", "path", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {range_bytes}L)")).alias("lo"))
    fields = [x.split() for x in RECORD.split(", ")]
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(n, kinds[t]) for n, t in fields])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        def batch(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({n: [r.get(n) for r in rows] for n in schema.names}, schema=schema)

        for b in batches:
            for row in b.to_pylist():
                store = fs.FileSystem.from_uri(row["folder"])[0]
                rows, held = [], 0
                with store.open_input_file(row["path"]) as f:
                    for r in salvage(f, row["bytes"], row["lo"], row["lo"] + range_bytes):
                        if not payloads:
                            r.pop("payload", None)
                        rows.append(r | {"path": row["path"]})
                        held += len(r.get("payload") or b"")
                        if len(rows) >= 4096 or held > (8 << 20):
                            yield batch(rows)
                            rows, held = [], 0
                if rows:
                    yield batch(rows)

    return ranges.repartition(partitions, "path", "lo").mapInArrow(read, RECORD)
