"""Media columns: texts as 8-bit audio, stored as content-defined chunks and verified on reading.

A text's UTF-8 bytes, padded with spaces, are the samples of a mono 8-bit WAV file. A rolling gear
hash cuts the file where its content says so; chunks are known by digest. A chunk that several
distinct files (or places) share is stored once, by its first owner, as found by Spark joins over
digests; the other chunks of a file are stored together with the file's ordered chunk list. Reading
joins the shared chunks back, puts every file together in its order and checks its SHA-256.

``media_manifest`` -> ``write_store`` -> ``read_store``; each distinct file is stored and read once.

Defined results: a null text is empty; an empty text has one padded block; equal texts share one
file; repeated rows are stored once and stay as rows; a very long text is one file of many chunks,
cut and measured in blocks of ``BLOCK`` bytes; an empty table gives an empty store; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, salted, scratch_path, stored, text_or_empty

FRAME, RATE = 192, 8000
LEAST, MOST, MASK_BITS = 1024, 16384, 12
DIGEST = 16  # bytes of a chunk's SHA-256
GEAR = np.random.Generator(np.random.PCG64(6)).integers(0, 1 << 32, 256, dtype=np.uint32)
SHUFFLE_LEVEL, STORE_LEVEL, BLOCK = 9, 15, 1 << 18
DICT_ROWS, DICT_CHARS, DICT_BYTES = 800, 8192, 112640  # bound of the sample that the compression dictionary is made of


def payload_of(text: bytes) -> bytes:
    return text + b" " * (-len(text) % FRAME or (0 if text else FRAME))


def wav_of(payload: bytes) -> bytes:
    n = len(payload)
    head = b"RIFF" + (36 + n).to_bytes(4, "little") + b"WAVEfmt " + (16).to_bytes(4, "little") + b"\1\0\1\0"
    return head + RATE.to_bytes(4, "little") * 2 + b"\1\0\x08\0data" + n.to_bytes(4, "little") + payload


def samples_of(wav: bytes) -> bytes:
    if wav[:4] != b"RIFF" or wav[36:40] != b"data" or int.from_bytes(wav[40:44], "little") != len(wav) - 44:
        raise ValueError("not a file of this store")
    return wav[44:]


def gear_cuts(data: np.ndarray) -> np.ndarray:
    """The places after which the top MASK_BITS bits of the rolling hash of the last 32 bytes are zero."""
    out = []
    for at in range(0, len(data), BLOCK):
        before = min(at, 31)  # bytes that only warm the hash up
        h = GEAR[data[at - before : at + BLOCK]]
        for k in (1, 2, 4, 8, 16):
            h[k:] += h[:-k].copy() << np.uint32(k)
        out.append(np.flatnonzero((h[before:] >> np.uint32(32 - MASK_BITS)) == 0) + at + 1)
    return np.concatenate(out) if out else np.empty(0, np.int64)


def feature(x: np.ndarray) -> str:
    """Mean (thousandths), power, peak, turning points and distinct values of 8-bit samples."""
    value, seen, turns = np.arange(256), np.zeros(256, np.int64), 0
    for at in range(0, len(x), BLOCK):
        seen += np.bincount(x[at : at + BLOCK], minlength=256)
        v = x[at : at + BLOCK + 2]
        slope = (v[1:] > v[:-1]).astype(np.int8) - (v[1:] < v[:-1])
        turns += int((slope[1:] != slope[:-1]).sum())
    mean, power = int((seen * value).sum()) * 1000 // len(x), int((seen * value * value).sum()) // len(x)
    return f"mean={mean};power={power};peak={int(np.flatnonzero(seen).max())};turns={turns};distinct={int((seen > 0).sum())}"


def chunk_sizes(data: bytes, cuts: np.ndarray | None = None) -> list[int]:
    """Sizes of the chunks, LEAST to MOST bytes each (the last one may be shorter)."""
    cuts = gear_cuts(np.frombuffer(data, np.uint8)) if cuts is None else cuts
    out, at, end = [], 0, len(data)
    while end - at > LEAST:
        i = np.searchsorted(cuts, at + LEAST)
        to = min(int(cuts[i]) if i < len(cuts) else end, at + MOST, end)
        out.append(to - at)
        at = to
    return [*out, end - at] if end > at else out


def _files(batches: Iterator[pa.RecordBatch], most: int = 1 << 21) -> Iterator[tuple[pa.Array, list[bytes], pa.RecordBatch]]:
    for whole in batches:
        for b in (whole.slice(i, 256) for i in range(0, whole.num_rows, 256)):
            texts = b.column("text").to_pylist()
            yield b.column("doc_id"), texts, b


def media_manifest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, mid (SHA-256 of the file), digests, sizes. No payload. Stored."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts, _ in _files(batches):
            mids, digests, sizes = [], [], []
            for t in texts:
                wav = wav_of(payload_of(t))
                n, at, own = chunk_sizes(wav), 0, []
                for s in n:
                    own.append(hashlib.sha256(wav[at : at + s]).digest()[:DIGEST])
                    at += s
                mids.append(hashlib.sha256(wav).digest())
                digests.append(own)
                sizes.append(n)
            yield pa.RecordBatch.from_arrays([ids, pa.array([len(t) for t in texts], pa.int64()), pa.array(mids), pa.array(digests, pa.list_(pa.binary())), pa.array(sizes, pa.list_(pa.int32()))], ["doc_id", "n_bytes", "mid", "digests", "sizes"])

    rows = docs.select("doc_id", F.encode(text_or_empty("text"), "UTF-8").alias("text"))
    return stored(rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, mid binary, digests array<binary>, sizes array<int>"), "media-manifest")


def shared_chunks(files: DataFrame) -> DataFrame:
    """mid, shared: array of (idx, writes) of the chunks that occur at several places of the distinct
    files; writes: whether this place is the chunk's owner."""
    places = files.select("mid", F.posexplode("digests").alias("idx", "digest"))
    twice = places.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("mid", "idx")).alias("owner")).where("n > 1").select("digest", "owner", "n")
    twice = stored(twice, "chunk-owners")
    hot = hot_keys(twice, ["digest"], "n", twice.agg(F.sum("n")).first()[0] or 0)
    found = salted(places.select("mid", "idx", "digest"), twice.drop("n"), ["digest"], ["mid", "idx"], hot)
    return found.groupBy("mid").agg(F.sort_array(F.collect_list(F.struct("idx", (F.struct("mid", "idx") == F.col("owner")).alias("writes")))).alias("shared"))


def dictionary_texts(docs: DataFrame) -> DataFrame:
    """x: at most DICT_ROWS texts, of each at most DICT_CHARS characters: id hashes fall into DICT_ROWS
    bins, each of which gives the text of its least hash (one text, if rows repeat its doc_id)."""
    ids = docs.where("text <> ''").select(F.xxhash64("doc_id").alias("h"), "text")
    picked = ids.groupBy(F.pmod("h", F.lit(DICT_ROWS)).alias("bin")).agg(F.min("h").alias("h")).select("h")
    found = ids.join(F.broadcast(picked), "h").select("h", F.left("text", F.lit(DICT_CHARS)).alias("x"))  # DICT_ROWS rows
    return found.groupBy("h").agg(F.min("x").alias("x")).select("x")


def dictionary_of(docs: DataFrame) -> bytes:
    """A zstd dictionary from the texts of ``dictionary_texts``."""
    import zstandard

    texts = sorted(r["x"] for r in dictionary_texts(docs).collect())
    try:
        return zstandard.train_dictionary(DICT_BYTES, [x.encode() for x in texts]).as_bytes()
    except (zstandard.ZstdError, ValueError):  # too few texts for one
        return b""


def _codec(level: int, dictionary: bytes):
    import zstandard

    d = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
    return zstandard.ZstdCompressor(level=level, dict_data=d), zstandard.ZstdDecompressor(dict_data=d)


def write_store(docs: DataFrame, manifest: DataFrame, folder: str | None = None) -> str:
    """Writes the store's tables (kind=pack, chunk and dict, the compression dictionary); returns its folder."""
    folder = folder or scratch_path(docs.sparkSession, "media-store")
    dictionary = dictionary_of(docs)
    files = manifest.groupBy("mid").agg(F.min("doc_id").alias("doc_id"), F.first("digests").alias("digests"), F.first("sizes").alias("sizes"))
    files = stored(files, "media-files")
    files = files.join(shared_chunks(files), "mid", "left")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, _ = _codec(SHUFFLE_LEVEL, dictionary)
        for ids, texts, _ in _files(batches):
            mids = [hashlib.sha256(wav_of(payload_of(t))).digest() for t in texts]
            yield pa.RecordBatch.from_arrays([ids, pa.array(mids), pa.array([z.compress(t) for t in texts])], ["doc_id", "mid", "packed"])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (z, _), (_, unz) = _codec(STORE_LEVEL, dictionary), _codec(1, dictionary)
        names = ["kind", "key", "digests", "sizes", "shared", "data"]
        types = [pa.string(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
        for b in batches:
            rows: list[tuple] = []
            for r in b.to_pylist():
                wav, at, own = wav_of(payload_of(unz.decompress(r["packed"]))), 0, []
                shared = {s["idx"]: s["writes"] for s in r["shared"] or []}
                for i, (d, n) in enumerate(zip(r["digests"], r["sizes"], strict=True)):
                    piece = wav[at : at + n]
                    at += n
                    if i not in shared:
                        own.append(piece)
                    elif shared[i]:
                        rows.append(("chunk", d, None, None, None, z.compress(piece)))
                rows.append(("pack", r["mid"], r["digests"], r["sizes"], sorted(shared), z.compress(b"".join(own))))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    rows = docs.select("doc_id", F.encode(text_or_empty("text"), "UTF-8").alias("text")).mapInArrow(squeeze, f"doc_id {kind}, mid binary, packed binary")
    if not manifest.groupBy("doc_id", "mid").count().where("count > 1").isEmpty():  # repeated rows
        rows = rows.dropDuplicates(["doc_id", "mid"])
    files = files.withColumnRenamed("doc_id", "owner").withColumnRenamed("mid", "file").hint("shuffle_hash")
    df = rows.join(files, rows["doc_id"].eqNullSafe(files["owner"]) & (rows["mid"] == files["file"])).select("mid", "packed", "digests", "sizes", "shared")
    made = df.mapInArrow(lay, "kind string, key binary, digests array<binary>, sizes array<int>, shared array<int>, data binary")
    made.write.partitionBy("kind").option("compression", "uncompressed").parquet(folder)
    one = docs.sparkSession.createDataFrame([(bytearray(dictionary),)], "data binary").selectExpr("cast('' as binary) as key", "cast(null as array<binary>) as digests", "cast(null as array<int>) as sizes", "cast(null as array<int>) as shared", "data", "'dict' as kind")
    one.write.mode("append").partitionBy("kind").parquet(folder)
    return folder


STORE = "key binary, digests array<binary>, sizes array<int>, shared array<int>, data binary, kind string"


def read_store(spark, folder: str) -> DataFrame:
    """mid, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of every
    file of the store, put together from its chunks and verified; a row a file. Stored."""
    store = spark.read.schema(STORE).parquet(folder)
    packs, chunks = store.where("kind = 'pack'"), store.where("kind = 'chunk'").select(F.col("key").alias("digest"), "data")

    dictionary = bytes(store.where("kind = 'dict'").first()["data"])  # DICT_BYTES at most

    def join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, unz = _codec(1, dictionary)
        for b in batches:
            out = []
            for r in b.to_pylist():
                got = {p["idx"]: p["data"] for p in r["got"] or []}
                own, at, parts, cache = unz.decompress(r["data"]), 0, [], set(r["shared"])
                for i, (d, n) in enumerate(zip(r["digests"], r["sizes"], strict=True)):
                    if i in cache:
                        parts.append(unz.decompress(got[i]))
                    else:
                        parts.append(own[at : at + n])
                        at += n
                    if hashlib.sha256(parts[-1]).digest()[:DIGEST] != d:
                        raise ValueError("a chunk differs from its digest")
                wav = b"".join(parts)
                if (mid := hashlib.sha256(wav).digest()) != r["key"]:
                    raise ValueError("a file differs from its digest")
                x = samples_of(wav)
                out.append((mid, len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-16:]), len(wav), mid.hex(), feature(np.frombuffer(x, np.uint8))))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["mid", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    places = packs.where("size(shared) > 0").select("key", "digests", F.explode("shared").alias("idx")).select("key", "idx", F.get("digests", F.col("idx")).alias("digest"))
    hot = hot_keys(places.groupBy("digest").agg(F.count("*").alias("n")), ["digest"], "n", places.count())
    got = salted(places, chunks, ["digest"], ["key", "idx"], hot).groupBy("key").agg(F.collect_list(F.struct("idx", "data")).alias("got"))
    some = packs.where("size(shared) > 0").join(got, "key").select("key", "digests", "sizes", "shared", "data", "got")
    none = packs.where("size(shared) = 0").select("key", "digests", "sizes", "shared", "data", F.lit(None).cast("array<struct<idx:int,data:binary>>").alias("got"))
    kind = "mid binary, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return stored(some.mapInArrow(join_up, kind).union(none.mapInArrow(join_up, kind)), "media-read")


def media_columns(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the columns of read_store: a row for each row of docs."""
    manifest = media_manifest(docs)
    files = read_store(docs.sparkSession, write_store(docs, manifest))
    hot = hot_keys(manifest.groupBy("mid").agg(F.count("*").alias("n")), ["mid"], "n", manifest.count())
    return salted(manifest.select("doc_id", "n_bytes", "mid"), files, ["mid"], ["doc_id"], hot).drop("mid")
