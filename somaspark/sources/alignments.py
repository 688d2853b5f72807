"""Alignment files of the public BAM format as a Spark data source: S4, S5, S6, P1.

A file is a row of gzip blocks; a virtual offset names a block and a place in it. The index beside
the file (``.bai``) lists, for bins of a contig, the ranges of offsets that hold their reads and, for
every 16,384 bases, the first read that reaches there. ``region_chunks`` takes from both the ranges
that can hold reads of a region; they are cut at offsets of the index into partitions, so that
executors read disjoint ranges and blocks outside of the region are never opened.

Conditions on contig, s and e of a query are pushed down to the index; Spark checks them again on
the rows. Every executor must be able to open the path. A file without an index is one partition.
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

SCHEMA = "name string, contig string, s int, e int, mapq int, flag int, cigar string, mate_contig string, mate_s int, insert_size int, seq string, quals string, md string, nm int, sa string"
KINDS = {"string": pa.string(), "int": pa.int32()}
ARROW = pa.schema([(c, KINDS[k]) for c, k in (x.split() for x in SCHEMA.split(", "))])
#: Fixed values of the format.
OPS, BASES = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
SIZES = {"A": "c", "c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, SECONDARY, QC_FAIL, DUPLICATE = 1, 2, 4, 8, 16, 32, 256, 512, 1024
LINEAR, FARTHEST = 14, 1 << 29
PART_BYTES, BATCH = 32 << 20, 4096


class Blocks:
    """A file of gzip blocks, read from a virtual offset on; opened counts the blocks."""

    def __init__(self, path: str, at: int = 0):
        self.file, self.opened = open(path, "rb"), 0
        self.block, self.next, self.data, self.place = -1, 0, b"", 0
        self._open(at >> 16)
        self.place = at & 0xFFFF

    def _open(self, where: int) -> bool:
        self.file.seek(where)
        head = self.file.read(12)
        self.block, self.data, self.place = where, b"", 0
        if len(head) < 12:
            self.next = where
            return False
        extra = self.file.read(struct.unpack_from("<H", head, 10)[0])
        at, size = 0, None
        while at + 4 <= len(extra):
            tag, n = extra[at : at + 2], struct.unpack_from("<H", extra, at + 2)[0]
            if tag == b"BC":
                size = struct.unpack_from("<H", extra, at + 4)[0] + 1
            at += 4 + n
        if head[:2] != b"\x1f\x8b" or size is None:
            raise ValueError(f"no block of a block-gzip file at byte {where}")
        self.data = zlib.decompress(self.file.read(size - 12 - len(extra) - 8), -15)
        self.next, self.opened = where + size, self.opened + 1
        return True

    def offset(self) -> int:
        """Of the next byte."""
        if self.place >= len(self.data):
            return self.next << 16
        return self.block << 16 | self.place

    def read(self, n: int) -> bytes:
        out = self.data[self.place : self.place + n]
        self.place += len(out)
        while len(out) < n:
            if not self._open(self.next):
                return out
            more = self.data[: n - len(out)]
            self.place = len(more)
            out += more
        return out


def file_head(blocks: Blocks) -> list[tuple[str, int]]:
    """The contigs and their lengths; blocks then stand at the first record."""
    if blocks.read(4) != b"BAM\1":
        raise ValueError("not an alignment file")
    blocks.read(struct.unpack("<i", blocks.read(4))[0])
    out = []
    for _ in range(struct.unpack("<i", blocks.read(4))[0]):
        name = blocks.read(struct.unpack("<i", blocks.read(4))[0])[:-1].decode()
        out.append((name, struct.unpack("<i", blocks.read(4))[0]))
    return out


@dataclass
class ContigIndex:
    bins: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    linear: list[int] = field(default_factory=list)


def read_index(path: str) -> list[ContigIndex]:
    with open(path, "rb") as f:
        data = f.read()
    if data[:4] != b"BAI\1":
        raise ValueError(f"not an index of an alignment file: {path}")
    at = 4

    def take(kind: str) -> tuple:
        nonlocal at
        got = struct.unpack_from("<" + kind, data, at)
        at += struct.calcsize("<" + kind)
        return got

    out = []
    for _ in range(take("i")[0]):
        c = ContigIndex()
        for _ in range(take("i")[0]):
            number, n = take("Ii")
            c.bins[number] = [take("QQ") for _ in range(n)]
        c.linear = list(take(f"{take('i')[0]}Q"))
        c.bins.pop(37450, None)  # counts of reads, no ranges
        out.append(c)
    return out


def bins_of(lo: int, hi: int) -> Iterator[range]:
    """The bins that can hold reads of [lo, hi), a range a level."""
    first, shift = 0, 29
    for level in range(6):
        yield range(first + (lo >> shift), first + ((hi - 1) >> shift) + 1)
        first, shift = first + (1 << 3 * level), shift - 3


def region_chunks(index: ContigIndex, lo: int, hi: int) -> list[tuple[int, int]]:
    """Disjoint ranges of virtual offsets, in order, that hold all reads overlapping [lo, hi)."""
    lo, hi = max(lo, 0), min(hi, FARTHEST)
    if lo >= hi or not index.bins:
        return []
    least = next((x for x in reversed(index.linear[: (lo >> LINEAR) + 1]) if x), 0)
    found = sorted((max(b, least), e) for r in bins_of(lo, hi) for k in (r if len(r) < len(index.bins) else index.bins.keys() & set(r)) for b, e in index.bins.get(k, []) if e > least)
    out: list[tuple[int, int]] = []
    for b, e in found:
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def record(data: bytes, contigs: list[tuple[str, int]]) -> tuple | None:
    """One record as a row of SCHEMA, with the contig's number in front."""
    ref, pos, l_name, mapq, _, n_cigar, flag, l_seq, mate, mate_pos, tlen = struct.unpack_from("<iiBBHHHiiii", data)
    at = 32 + l_name
    name = data[32 : at - 1].decode()
    ops = struct.unpack_from(f"<{n_cigar}I", data, at)
    at += 4 * n_cigar
    cigar = "".join(f"{x >> 4}{OPS[x & 15]}" for x in ops)
    packed = data[at : at + (l_seq + 1) // 2]
    seq = "".join(BASES[b >> 4] + BASES[b & 15] for b in packed)[:l_seq]
    at += len(packed)
    raw = data[at : at + l_seq]
    quals = None if raw[:1] == b"\xff" else bytes(q + 33 for q in raw).decode()
    at += l_seq
    tags: dict[str, object] = {}
    while at + 3 <= len(data):
        tag, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind in "ZH":
            end = data.index(0, at)
            tags[tag], at = data[at:end].decode(), end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            at += 5 + n * struct.calcsize(SIZES[sub])
        else:
            tags[tag] = struct.unpack_from("<" + SIZES[kind], data, at)[0]
            at += struct.calcsize(SIZES[kind])
    end = pos + sum(x >> 4 for x in ops if OPS[x & 15] in "MDN=X")
    place = lambda i: contigs[i][0] if i >= 0 else None
    return ref, (name, place(ref), pos if pos >= 0 else None, end if pos >= 0 else None, mapq, flag, cigar, place(mate), mate_pos if mate_pos >= 0 else None, tlen, seq, quals, tags.get("MD"), tags.get("NM"), tags.get("SA"))


@dataclass
class Range(InputPartition):
    begin: int
    end: int | None  # None: up to the end of the file
    regions: list[tuple[int, int, int]] | None  # (contig's number, lo, hi); None: every read


class AlignmentReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path = options["path"].removeprefix("file://")
        self.index = options.get("index", self.path + ".bai")
        self.part_bytes = int(options.get("partBytes", PART_BYTES))
        text = options.get("regions")
        self.regions = [(c, int(lo), int(hi)) for c, lo, hi in (r.rsplit(":", 1)[0:1] + r.rsplit(":", 1)[1].split("-") for r in text.split(";"))] if text else None
        self.contig, self.lo, self.hi = None, 0, FARTHEST

    def pushFilters(self, filters: list[Filter]):
        for f in filters:
            match f:
                case EqualTo(("contig",), value):
                    self.contig = value
                case LessThan(("s",), value):
                    self.hi = min(self.hi, value)
                case LessThanOrEqual(("s",), value):
                    self.hi = min(self.hi, value + 1)
                case GreaterThan(("e",), value):
                    self.lo = max(self.lo, value)
                case GreaterThanOrEqual(("e",), value):
                    self.lo = max(self.lo, value - 1)
            yield f  # a range holds other reads too

    def partitions(self) -> list[Range]:
        blocks = Blocks(self.path)
        contigs = file_head(blocks)
        first = blocks.offset()
        if not os.path.exists(self.index):
            return [Range(first, None, None)]
        index, number = read_index(self.index), {name: i for i, (name, _) in enumerate(contigs)}
        asked = self.regions
        if asked is None and self.contig is not None:
            asked = [(self.contig, self.lo, self.hi)]
        elif asked is not None:
            asked = [(c, max(lo, self.lo), min(hi, self.hi)) for c, lo, hi in asked if self.contig in (None, c)]
        if asked is None:
            ends = sorted({x for c in index for x in c.linear if x > first})
            cuts = self._cut(first, None, ends)
            return [Range(b, e, None) for b, e in cuts]
        for c, _, _ in asked:
            if c not in number:
                raise ValueError(f"unknown contig: {c}")
        spans = [(number[c], lo, hi) for c, lo, hi in asked]
        chunks: list[tuple[int, int]] = []
        for b, e in sorted(x for i, lo, hi in spans for x in region_chunks(index[i], lo, hi)):
            if chunks and b <= chunks[-1][1]:
                chunks[-1] = (chunks[-1][0], max(e, chunks[-1][1]))
            else:
                chunks.append((b, e))
        stops = sorted({x for i in {s[0] for s in spans} for x in index[i].linear})
        return [Range(b, e, spans) for lo, hi in chunks for b, e in self._cut(lo, hi, [x for x in stops if lo < x < hi])] or [Range(0, 0, spans)]

    def _cut(self, lo: int, hi: int | None, stops: list[int]) -> list[tuple[int, int | None]]:
        """[lo, hi) cut at stops into ranges of about part_bytes."""
        out, at = [], lo
        for x in stops:
            if (x >> 16) - (at >> 16) >= self.part_bytes:
                out.append((at, x))
                at = x
        return [*out, (at, hi)]

    def rows(self, part: Range, blocks: Blocks, contigs: list[tuple[str, int]]) -> Iterator[tuple]:
        last = None
        if part.regions:
            last = max((i, hi) for i, _, hi in part.regions)
        while part.end is None or blocks.offset() < part.end:
            size = blocks.read(4)
            if len(size) < 4:
                return
            ref, row = record(blocks.read(struct.unpack("<i", size)[0]), contigs)
            if part.regions is None:
                yield row
                continue
            if ref < 0 or (ref, row[2]) >= last:
                return  # reads are in order of their place
            if any(i == ref and row[2] < hi and max(row[3], row[2] + 1) > lo for i, lo, hi in part.regions):
                yield row

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if part.end == 0:
            return
        contigs = file_head(Blocks(self.path))
        held: list[tuple] = []
        for row in self.rows(part, Blocks(self.path, part.begin), contigs):
            held.append(row)
            if len(held) == BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), ARROW, strict=True)], schema=ARROW)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), ARROW, strict=True)], schema=ARROW)


class Alignments(DataSource):
    """Options: path; index (else path + .bai); regions (``contig:lo-hi``, half-open from 0, joined by ``;``);
    partBytes (compressed bytes a partition)."""

    @classmethod
    def name(cls) -> str:
        return "alignments"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> AlignmentReader:
        return AlignmentReader(self.options)


def read_alignments(spark: SparkSession, path: str, regions: list[tuple[str, int, int]] | None = None, **options) -> DataFrame:
    """The reads of a file, or those that overlap any of the regions, each once."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Alignments)
    r = spark.read.format("alignments").options(**options)
    if regions is not None:
        r = r.option("regions", ";".join(f"{c}:{lo}-{hi}" for c, lo, hi in regions))
    return r.load(path)


def read_contigs(spark: SparkSession, path: str) -> DataFrame:
    """Ord, name, len of the contigs in a file's header."""
    rows = [(i, name, n) for i, (name, n) in enumerate(file_head(Blocks(path.removeprefix("file://"))))]
    return spark.createDataFrame(rows, "ord int, name string, len int")


def flag_filter(reads: DataFrame, min_mapq: int = 1, duplicates: bool = True, secondary: bool = True, qc_failed: bool = True, improper_pair: bool = False, mate_unmapped: bool = False, orientation: bool = False) -> DataFrame:
    """P1, P23 on a file's flags: each switch drops reads of its kind; so go reads without a CIGAR or a base
    on the reference. Proper orientation: both mates on one contig, on two strands, facing each other."""
    has = lambda bit: F.col("flag").bitwiseAND(bit) != 0
    df = reads.where((F.col("mapq") >= min_mapq) & (F.col("cigar") != "") & (F.col("e") > F.col("s")))
    for on, bad in ((secondary, has(SECONDARY)), (duplicates, has(DUPLICATE)), (qc_failed, has(QC_FAIL)), (improper_pair, ~has(PROPER)), (mate_unmapped, has(MATE_UNMAPPED))):
        df = df.where(~bad) if on else df
    if orientation:
        ahead = F.col("s") < F.col("mate_s")
        df = df.where(F.coalesce((F.col("contig") == F.col("mate_contig")) & (has(REVERSE) != has(MATE_REVERSE)) & (ahead != has(REVERSE)), F.lit(False)))
    return df


def region_reads(reads: DataFrame, regions: DataFrame, contained: bool = False) -> DataFrame:
    """Reads joined with the regions (contig, s, e; here r_s, r_e) they overlap or, with contained,
    that they span but for at most one base at the end."""
    from somaspark.operators.intervals import range_join

    df = range_join(reads, regions, 1 if contained else 0, strategy="auto")
    return df.where((F.col("s") <= F.col("r_s")) & (F.col("e") + 1 >= F.col("r_e"))) if contained else df
