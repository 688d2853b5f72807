"""Alignment files written here, block by block, and read back by region."""

import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from somaspark.sources import alignments as A

CONTIGS = [("chr1", 300_000), ("chr2", 90_000), ("empty", 500)]
ROW = [x.split()[0] for x in A.SCHEMA.split(", ")]


def block(data):
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    raw = z.compress(data) + z.flush()
    return struct.pack("<4BI2BH2BHH", 31, 139, 8, 4, 0, 0, 255, 6, 66, 67, 2, len(raw) + 25) + raw + struct.pack("<II", zlib.crc32(data), len(data))


def bin_of(lo, hi):
    for shift, first in ((14, 4681), (17, 585), (20, 73), (23, 9), (26, 1)):
        if lo >> shift == (hi - 1) >> shift:
            return first + (lo >> shift)
    return 0


def encoded(r):
    at = {c: i for i, (c, _) in enumerate(CONTIGS)}
    name = r["name"].encode() + b"\0"
    ops = [(int(n), o) for n, o in __import__("re").findall(r"(\d+)([A-Z=])", r["cigar"])]
    seq = [A.BASES.index(b) for b in r["seq"]] + [0]
    tags = b"MDZ" + r["md"].encode() + b"\0" if r["md"] else b""
    tags += b"XBBs" + struct.pack("<i3h", 3, 1, 2, 3) + b"XAAq" + b"XFf" + struct.pack("<f", 1.5)
    tags += b"NMC" + bytes([r["nm"]]) if r["nm"] is not None else b""
    pos = r["s"] if r["s"] is not None else -1
    body = struct.pack("<iiBBHHHiiii", at.get(r["contig"], -1), pos, len(name), r["mapq"], bin_of(pos, max(r["e"] or 0, pos + 1)) if pos >= 0 else 4680, len(ops), r["flag"], len(r["seq"]), at.get(r["mate_contig"], -1), -1 if r["mate_s"] is None else r["mate_s"], r["insert_size"])
    body += name + b"".join(struct.pack("<I", n << 4 | A.OPS.index(o)) for n, o in ops) + bytes(seq[i] << 4 | seq[i + 1] for i in range(0, len(r["seq"]), 2))
    body += bytes(ord(q) - 33 for q in r["quals"]) if r["quals"] else b"\xff" * len(r["seq"])
    return struct.pack("<i", len(body + tags)) + body + tags


def write(path, rows, block_bytes):
    """The file and its index; records run on over the blocks' ends."""
    head = b"@HD\tVN:1.6\n"
    data = b"BAM\1" + struct.pack("<i", len(head)) + head + struct.pack("<i", len(CONTIGS)) + b"".join(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n) for c, n in CONTIGS)
    ends = []
    for r in rows:
        start = len(data)
        data += encoded(r)
        ends.append((start, len(data)))
    starts, out = [], b""
    for i in range(0, len(data), block_bytes):
        starts.append(len(out))
        out += block(data[i : i + block_bytes])
    whole = len(out)
    with open(path, "wb") as f:
        f.write(out + block(b""))
    virtual = lambda p: (starts[p // block_bytes] << 16 | p % block_bytes) if p < len(data) else whole << 16
    index = [({}, {}) for _ in CONTIGS]
    for r, (a, z) in zip(rows, ends, strict=True):
        if r["s"] is None:
            continue
        bins, linear = index[[c for c, _ in CONTIGS].index(r["contig"])]
        end = max(r["e"], r["s"] + 1)
        spans = bins.setdefault(bin_of(r["s"], end), [])
        if spans and spans[-1][1] == virtual(a):
            spans[-1] = (spans[-1][0], virtual(z))
        else:
            spans.append((virtual(a), virtual(z)))
        for w in range(r["s"] >> 14, ((end - 1) >> 14) + 1):
            linear.setdefault(w, virtual(a))
    with open(f"{path}.bai", "wb") as f:
        f.write(b"BAI\1" + struct.pack("<i", len(index)))
        for bins, linear in index:
            f.write(struct.pack("<i", len(bins) + 1))
            for number, spans in bins.items():
                f.write(struct.pack("<Ii", number, len(spans)) + b"".join(struct.pack("<QQ", *x) for x in spans))
            f.write(struct.pack("<Ii4Q", 37450, 2, 0, 0, 1, 1))
            n = max(linear, default=-1) + 1
            f.write(struct.pack("<i", n) + b"".join(struct.pack("<Q", linear.get(w, 0)) for w in range(n)))
    return len(starts)


@pytest.fixture(scope="module")
def reads():
    r, out = random.Random(1), []
    for c, (contig, size) in enumerate(CONTIGS[:2]):
        for s in sorted(r.randrange(size - 3000) for _ in range(600)):
            n, gap = r.randrange(20, 120), r.choice([0, 0, 2, 2000])
            cigar = f"3S{n}M" + (f"{gap}D4M1I2H" if gap else "")
            length = 3 + n + (5 if gap else 0)
            out.append({"name": f"r{len(out)}", "contig": contig, "s": s, "e": s + n + (gap + 4 if gap else 0), "mapq": r.randrange(60), "flag": r.choice([0, 16, 1 | 2 | 32, 1 | 2 | 16, 1 | 8, 256, 512, 1024]), "cigar": cigar, "mate_contig": r.choice([None, contig, "chr1"]), "mate_s": r.randrange(size), "insert_size": r.randrange(-500, 500), "seq": "".join(r.choices("ACGTN", k=length)), "quals": r.choice([None, "".join(chr(33 + r.randrange(60)) for _ in range(length))]), "md": r.choice([None, f"{n}"]), "nm": r.choice([None, 3]), "sa": None})
    out.append(dict.fromkeys(ROW) | {"name": "lost", "mapq": 0, "flag": 4, "cigar": "", "insert_size": 0, "seq": "ACG", "quals": None})
    return out


@pytest.fixture(scope="module")
def path(reads, tmp_path_factory):
    p = f"{tmp_path_factory.mktemp('bam')}/a.bam"
    assert write(p, reads, 3000) > 40
    return p


def key(rows):
    return sorted((tuple(r[c] for c in ROW) for r in rows), key=repr)


def test_whole_files(spark, reads, path, tmp_path):
    assert key(A.read_alignments(spark, path).collect()) == key(reads)
    df = A.read_alignments(spark, path, partBytes=4000)
    assert df.rdd.getNumPartitions() > 5 and key(df.collect()) == key(reads)
    write(f"{tmp_path}/b.bam", reads, 60_000)
    (tmp_path / "b.bam.bai").unlink()
    assert key(A.read_alignments(spark, f"{tmp_path}/b.bam").collect()) == key(reads)
    assert [tuple(x) for x in A.read_contigs(spark, path).collect()] == [(i, *c) for i, c in enumerate(CONTIGS)]
    write(f"{tmp_path}/none.bam", [], 60_000)
    assert A.read_alignments(spark, f"{tmp_path}/none.bam").collect() == []


def test_regions(spark, reads, path):
    r = random.Random(2)
    for _ in range(6):
        c, n = r.choice(CONTIGS[:2])
        lo = r.randrange(n)
        hi = lo + r.choice([1, 50, 20_000])
        want = [x for x in reads if x["contig"] == c and x["s"] < hi and x["e"] > lo]
        assert key(A.read_alignments(spark, path, [(c, lo, hi)], partBytes=2000).collect()) == key(want)
        df = A.read_alignments(spark, path).where((F.col("contig") == c) & (F.col("s") < hi) & (F.col("e") > lo))
        assert key(df.collect()) == key(want)
    several = [("chr1", 10, 30_000), ("chr1", 20_000, 50_000), ("chr2", 0, 900), ("empty", 0, 9)]
    want = [x for x in reads if any(x["contig"] == c and x["s"] < hi and x["e"] > lo for c, lo, hi in several)]
    assert key(A.read_alignments(spark, path, several).collect()) == key(want)
    with pytest.raises(Exception, match="unknown contig"):
        A.read_alignments(spark, path, [("chr9", 0, 5)]).collect()


def test_only_the_blocks_of_a_region_are_opened(reads, path):
    reader = A.AlignmentReader({"path": path, "regions": "chr1:150000-151000"})
    contigs, opened, found = A.file_head(A.Blocks(path)), 0, []
    for part in reader.partitions():
        blocks = A.Blocks(path, part.begin)
        found += list(reader.rows(part, blocks, contigs))
        opened += blocks.opened
    assert len(found) == sum(x["contig"] == "chr1" and x["s"] < 151_000 and x["e"] > 150_000 for x in reads) > 0
    assert opened <= 6  # of over 40


def test_filters_and_contained_reads(spark, reads, path):
    df = A.read_alignments(spark, path)
    names = lambda d: sorted(x.name for x in d.select("name").collect())
    ok = lambda x, bits: x["cigar"] and not x["flag"] & bits and x["mapq"] >= 20
    assert names(A.flag_filter(df, 20)) == sorted(x["name"] for x in reads if ok(x, 256 | 512 | 1024))
    assert names(A.flag_filter(df, 20, duplicates=False, secondary=False, qc_failed=False, improper_pair=True, mate_unmapped=True)) == sorted(x["name"] for x in reads if ok(x, 8) and x["flag"] & 2)
    facing = lambda x: x["contig"] == x["mate_contig"] and bool(x["flag"] & 16) != bool(x["flag"] & 32) and (x["s"] < x["mate_s"]) != bool(x["flag"] & 16)
    assert names(A.flag_filter(df, 20, orientation=True)) == sorted(x["name"] for x in reads if ok(x, 256 | 512 | 1024) and facing(x))
    regions = [(i, "chr1", s, s + 30) for i, s in enumerate(range(0, 290_000, 500))]
    r = spark.createDataFrame(regions, "id int, contig string, s int, e int")
    for contained, test in ((False, lambda x, s, e: x["s"] < e and x["e"] > s), (True, lambda x, s, e: x["s"] <= s and x["e"] + 1 >= e)):
        got = sorted((x.name, x.r_id) for x in A.region_reads(df.where("contig is not null"), r, contained).collect())
        assert got == sorted((x["name"], i) for x in reads for i, c, s, e in regions if x["contig"] == c and test(x, s, e)) and got
