"""Two run-length codes of one read merged, and CIGARs cut and spliced: F4, N11, J14, S14.

A read's codes are short and walked once, in order, by a small step a read inside Arrow batches: array
expressions over them are interpreted and took several times as long. MD tags and CIGARs meet in the
joint order of the places where their runs begin.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .cigar import CIGAR_OP, ON_REFERENCE, let, starts

IN_READ = ("M", "I", "S", "=", "X")
ALIGNED = ("M", "=", "X")
MD_PARTS = re.compile(r"[0-9]+|\^[A-Z]+|[A-Z]")
MOST = (1 << 31) - 1  # no place lies beyond
Ops = list[tuple[str, int]]
INFO = "idx int, query string, pos int, cigar string, start_idx int, end_idx int, del_start int, del_end int, pos_start int, pos_end int"


def md_snvs(reads: DataFrame, key: list[str]) -> DataFrame:
    """key, contig, pos, ref, alt, qual of every substitution an MD tag names, with the read's base.

    reads: contig, s (where the first aligned base lies), cigar, md, seq (hard-clipped bases left out) and,
    optionally, quals (one character a base, 33 more than its quality; qual is null without it). The
    substitution lies in the run of aligned bases that begins last before it. A tag that goes past the
    CIGAR's reference length says nothing there; a null tag or CIGAR gives no row."""
    df = reads.where("md is not null and cigar is not null and seq is not null").select(*key, "contig", F.col("s").cast("int").alias("s"), "cigar", "md", "seq", (F.col("quals") if "quals" in reads.columns else F.lit(None).cast("string")).alias("quals"))
    kept = [*key, "contig", "s"]
    added = {"at": pa.int32(), "ref": pa.string(), "alt": pa.string(), "qual": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, read in enumerate(zip(*(batch.column(c).to_pylist() for c in ("cigar", "md", "seq", "quals")), strict=True)):
                subs = substitutions(*read)
                rows += [i] * len(subs)
                found += subs
            columns = list(zip(*found, strict=True)) or [[]] * len(added)
            own = [batch.column(c).take(pa.array(rows, pa.int32())) for c in kept]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, columns, added.values())], [*kept, *added])

    out = T.StructType([df.schema[c] for c in kept]).add("at", T.IntegerType()).add("ref", T.StringType()).add("alt", T.StringType()).add("qual", T.IntegerType())
    return df.mapInArrow(run, out).select(*key, "contig", (F.col("s") + F.col("at")).alias("pos"), "ref", "alt", "qual")


@lru_cache(1 << 15)
def aligned_runs(cigar: str) -> list[tuple[int, int, int]]:
    """(place on the reference, length, place in the read) of the aligned runs, in order."""
    runs, r, q = [], 0, 0
    for n, op in CIGAR_OP.findall(cigar):
        n = int(n)
        if op in ALIGNED:
            runs.append((r, n, q))
        r += n if op in ON_REFERENCE else 0
        q += n if op in IN_READ else 0
    return sorted(runs)


def substitutions(cigar: str, md: str, seq: str, quals: str | None) -> list[tuple[int, str, str, int | None]]:
    """(place on the reference from the read's first aligned base, ref, alt, qual) of one read."""
    runs = aligned_runs(cigar)
    out, at, k, last = [], 0, 0, None
    for t in MD_PARTS.findall(md.upper()):
        if t.isdigit():
            at += int(t)
        elif t[0] == "^":
            at += len(t) - 1
        else:
            while k < len(runs) and runs[k][0] <= at:  # both codes in order: the run that began last
                last, k = runs[k], k + 1
            if last and at - last[0] < last[1]:
                i = last[2] + at - last[0]
                if i < len(seq):
                    out.append((at, t, seq[i], None if quals is None else (ord(quals[i]) if i < len(quals) else 0) - 33))
            at += 1
        if at > MOST:
            break
    return out


def joined(ops: Column) -> Column:
    """Neighbours of one op become one, empty ones go: by prefix sums over the places where the op changes."""

    def of(xs: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(0), F.size(xs) - 1), lambda i: (i == 0) | (F.get(xs, i)["op"] != F.get(xs, i - 1)["op"]))
        lens = F.concat(F.transform(xs, lambda x: x["len"]), F.array(F.lit(0)))  # so that the last sum is the total
        return let(F.struct(heads.alias("h"), starts(lens).alias("p")), lambda t: F.transform(t["h"], lambda i, j: F.struct(F.get(xs, i)["op"].alias("op"), (F.get(t["p"], F.coalesce(F.get(t["h"], j + 1), F.size(xs))) - F.get(t["p"], i)).alias("len"))))

    filled = F.filter(ops, lambda x: x["len"] > 0)
    return let(filled, lambda xs: F.when(F.size(xs) == 0, xs).otherwise(of(xs)))


def _joined(ops: Ops) -> Ops:
    """Neighbours of one op become one, empty ones go."""
    out: Ops = []
    for op, n in ops:
        if n > 0 and out and out[-1][0] == op:
            out[-1] = (op, out[-1][1] + n)
        elif n > 0:
            out.append((op, n))
    return out


def cut(ops: list[tuple[str, int, int]], lo: int, hi: int, off_lo: int, off_hi: int) -> Ops:
    """The ops (with their places) between two places of the read, lo up to hi: deletions at a border stay,
    shortened by off_lo and off_hi; hard clips are not among them."""
    out = []
    for op, n, p in ops:
        if op in IN_READ:
            n = min(p + n, hi) - max(p, lo)
        elif op == "H" or not lo <= p <= hi:
            continue
        else:
            n -= (off_lo if p == lo else 0) + (off_hi if p == hi else 0)
        if n > 0:
            out.append((op, n))
    return out


def trimmed(ops: Ops) -> Ops:
    """Without a deletion at an end, or right inside a soft clip at an end."""
    for _ in range(2):  # the last end first
        ops = ops[::-1]
        if len(ops) > 2 and ops[0][0] == "S" and ops[1][0] == "D":
            ops = ops[:1] + ops[2:]
        elif ops and ops[0][0] == "D":
            ops = ops[1:]
    return ops


def spliced(cigar: Column, edits: Column) -> Column:
    """A CIGAR with the edits put in. edits: array of (start_idx, end_idx, del_start, del_end,
    excess_start, excess_end, new_cigar), in order and apart; places count bases of the read from 0.

    The bases from start_idx to end_idx get the ops of new_cigar. A deletion right before them loses
    del_start bases, one right after them del_end. An excess at a side must be covered by such a deletion
    (at the read's end or before a soft clip none is needed); else the CIGAR stays as it is, and it also
    does if the edits would change the read's length. Hard clips stay at the ends."""


    @F.arrow_udf("string")
    def new(cigars: pa.Array, edits: pa.Array) -> pa.Array:
        at = edits.offsets.to_pylist()
        fields = edits.values.flatten()
        rows = list(zip(*(x.to_pylist() for x in fields), strict=True))
        return pa.array([c if c is None or b == a else put_in(c, rows[a:b]) for c, a, b in zip(cigars.to_pylist(), at[:-1], at[1:], strict=True)], pa.string())

    return new(cigar, edits)


def put_in(cigar: str, edits: list[tuple]) -> str:
    """``spliced`` for one read. A null place is none; a null excess lets nothing be put in."""
    ops, at = [], 0
    for n, op in CIGAR_OP.findall(cigar):
        ops.append((op, int(n), at))
        at += int(n) if op in IN_READ else 0
    total = at
    gap_at = lambda p: max((n for op, n, q in ops if op == "D" and q == p), default=0)
    pieces: Ops = []
    lo, off_lo = 0, 0
    for start, end, del_start, del_end, excess_start, excess_end, new_cigar in edits:
        if excess_start is None or (excess_start > 0 and gap_at(start) < excess_start):
            return cigar
        behind = None if end is None else end + 1
        after = gap_at(behind)
        at_end = after == 0 and behind is not None and (behind >= total or any(op == "S" and q <= behind < q + n for op, n, q in ops))
        if not at_end and (excess_end is None or (excess_end > 0 and after < excess_end)):
            return cigar
        off = max(del_start or 0, excess_start) if excess_start > 0 else del_start or 0
        pieces += cut(ops, lo, total if start is None else start, off_lo, off)
        pieces += [(op, int(n)) for n, op in CIGAR_OP.findall(new_cigar or "")]
        lo = 0 if end is None else end + 1
        covered = excess_end is not None and 0 < excess_end <= after
        off_lo = (excess_end if del_end is None else max(del_end, excess_end)) if covered else del_end or 0
    pieces += cut(ops, lo, total, off_lo, 0)
    hard = lambda i: [x[:2] for x in ops[i:][:1] if x[0] == "H"]
    made = trimmed(_joined(hard(0) + pieces + (hard(-1) if len(ops) > 1 else [])))
    same = sum(n for op, n in made if op in IN_READ) == total
    return "".join(f"{n}{op}" for op, n in made) if same else cigar


def rewritten(reads: DataFrame, realigned: DataFrame, key: tuple[str, ...] = ("query", "pos", "cigar")) -> DataFrame:
    """Reads with new_cigar. realigned: a row an edit, with the read's key and spliced's fields.

    Reads without an edit keep their CIGAR. A read's edits are in one row; there are as many as regions
    it crosses."""
    fields = ["start_idx", "end_idx", "del_start", "del_end", "excess_start", "excess_end", "new_cigar"]
    edits = realigned.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("edits"))
    df = reads.join(edits, list(key), "left")
    return df.withColumn("new_cigar", F.when(F.col("edits").isNull(), F.col("cigar")).otherwise(spliced(F.col("cigar"), F.col("edits")))).drop("edits")


def read_info(spark: SparkSession, path: str) -> DataFrame:
    """The table of what was realigned in a region; tab-separated, without a header."""
    return spark.read.schema(INFO).csv(path, sep="\t", quote="|", mode="FAILFAST")


def write_info(df: DataFrame, path: str) -> None:
    df.select(*[c.split()[0] for c in INFO.split(", ")]).write.csv(path, sep="\t", quote="|")
