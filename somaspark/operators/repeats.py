"""Tandem repeats of the reference and regions extended over them (F16), by an as-of join.

``tandem_runs`` lists the maximal stretches over which each base equals the one ``unit`` before or
after it; the chunks of an Arrow batch find theirs by comparing one byte array, stretches that touch a chunk's border are merged
with their neighbours'. A place lies in a repeat of a unit if the last run that begins at or before
it reaches on for a unit: one look-up, however long the repeat is, so nothing walks base by base
and no contig is one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .intervals import STRETCH, islands
from .stretches import carried, inside, kept, up_to

UNITS = (2, 3, 4)
#: Units tried at a region's start and end: at once, and again from REACH bases back if none fits.
FIRST, AGAIN = {"left": UNITS, "right": UNITS}, {"left": (3, 4), "right": UNITS}
REACH = 3


def tandem_runs(reference: DataFrame, units: tuple[int, ...] = UNITS, chunk: int = 64) -> DataFrame:
    """contig, unit, s, e: the maximal runs of places p with base(p) = base(p + unit), a unit long at least.

    reference: contig, start (a multiple of chunk), seq. A run of one base only is none; nor is a base
    other than A, C, G and T a match. Where a chunk is missing, runs end."""
    more = reference.select("contig", (F.col("start") - chunk).alias("start"), F.upper(F.left("seq", F.lit(max(units)))).alias("more"))
    whole = F.length("seq") == chunk  # a short chunk ends its contig
    df = reference.join(more, ["contig", "start"], "left").select("contig", "start", F.length("seq").alias("n"), F.concat(F.upper("seq"), F.when(whole, F.coalesce("more", F.lit(""))).otherwise(F.lit(""))).alias("seq"))
    df = df.where("seq is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [x.encode("ascii", "replace") for x in batch.column("seq").to_pylist()]
            if not texts:
                continue
            gap = max(units)
            flat = np.frombuffer((b"\n" * gap).join([*texts, b""]), np.uint8)
            ends = np.cumsum([len(x) + gap for x in texts])
            begin, n = ends - [len(x) + gap for x in texts], batch.column("n").to_numpy()
            own = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
            base = np.isin(flat, np.frombuffer(b"ACGT", np.uint8)) & (np.arange(len(flat)) - begin[own] < n[own])
            for unit in units:
                equal = np.append(base[:-unit] & (flat[:-unit] == flat[unit:]), np.zeros(unit, bool))
                edge = np.flatnonzero(np.diff(equal.astype(np.int8), prepend=0, append=0))
                a, z = edge[::2], edge[1::2] - 1
                row = own[a]
                border = (a == begin[row]) | (z == begin[row] + n[row] - 1)
                plain = np.all([flat[a + j] == flat[a] for j in range(1, unit)], axis=0) if unit > 1 else np.ones(len(a), bool)
                keep = (border | (z - a + 1 >= unit)) & ~plain
                a, z, row = a[keep], z[keep], row[keep]
                places = [pa.array(x, pa.int32()) for x in (np.full(len(a), unit), a - begin[row], z - begin[row])]
                yield pa.RecordBatch.from_arrays([batch.column(c).take(pa.array(row)) for c in ("contig", "start")] + places, ["contig", "start", "unit", "a", "z"])

    out = T.StructType([df.schema["contig"], df.schema["start"]]).add("unit", T.IntegerType()).add("a", T.IntegerType()).add("z", T.IntegerType())
    runs = df.mapInArrow(run, out).select("contig", "unit", (F.col("start") + F.col("a")).alias("s"), (F.col("start") + F.col("z") + 1).alias("e"))
    merged = islands(kept(runs), 0, ("contig", "unit")).groupBy("contig", "unit", "island").agg(F.min("s").alias("s"), F.max("e").alias("e"))
    return merged.where(F.col("e") - F.col("s") >= F.col("unit")).select("contig", "unit", "s", "e")


def as_of(points: DataFrame, table: DataFrame, by: list[str], at: str, key: str, size: int = STRETCH) -> DataFrame:
    """points with ``last``: the row of table (its columns but for by, as a struct that begins with key)
    of the largest key not over the point's place; null without one.

    Both sides meet in one order, stretch by stretch; what a stretch takes over from all before it is
    a row a stretch."""
    rest = [c for c in table.columns if c not in by and c != key]
    held = F.struct(key, *rest)
    row = F.struct(*points.columns)
    kind = table.select(held.alias("x")).schema["x"].dataType
    a = table.select(*by, F.col(key).alias("_at"), F.lit(0).alias("_side"), held.alias("_held"), F.lit(None).cast(points.select(row.alias("x")).schema["x"].dataType).alias("_row"))
    b = points.select(*by, F.col(at).alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(kind).alias("_held"), row.alias("_row"))
    df = carried(a.unionByName(b), by, F.shiftright("_at", size.bit_length() - 1), before={"_before": (F.max, "_held")})
    last = F.coalesce(F.max("_held").over(up_to(inside(by, "_at", "_side"))), F.col("_before"))
    return df.withColumn("last", last).where("_side = 1").select("_row.*", "last")


def extend_repeats(regions: DataFrame, runs: DataFrame, lengths: DataFrame, pad: int = 1) -> DataFrame:
    """F16: regions (id, contig, s, e) with new ends s and e beyond the repeats that begin or end there.

    From pad + REACH bases outside, units of 2, 3 and 4 bases are tried in this order and the first that
    repeats there is followed to the end of its run; if none does, the search starts again REACH bases
    further in. Starts stay at 0 or above and ends within the contig (lengths: contig, length). A
    region whose padded text is shorter than two units is not extended by that unit. A null end or an
    unknown contig gives no row."""
    df = regions.select("id", "contig", "s", "e").join(lengths.select("contig", "length"), "contig")
    df = df.withColumns({"s0": F.greatest(F.col("s") - pad - REACH, F.lit(1)), "e0": F.least(F.col("e") + pad + REACH, F.col("length") - 2)}).where("s is not null and e is not null")
    tries = [(side, k, u) for side in FIRST for k, group in ((0, FIRST), (1, AGAIN)) for u in group[side]]
    asked = df.select("id", "contig", "s0", "e0", F.explode(F.array(*[F.struct(F.lit(side).alias("side"), F.lit(k).alias("again"), F.lit(u).alias("unit")) for side, k, u in tries])).alias("try_")).select("id", "contig", "s0", "e0", "try_.*")
    start, end = F.col("s0") + REACH * F.col("again"), F.col("e0") - REACH * F.col("again")
    asked = asked.withColumn("p", F.when(F.col("side") == "left", start).otherwise(end - 2 * F.col("unit") + 1).cast("int"))
    met = as_of(asked, runs, ["contig", "unit"], "p", "s").where(F.col("last.e") >= F.col("p") + F.col("unit"))
    # how far the unit carries on: whole units, the last of which may leave the run
    steps = F.when(F.col("side") == "left", F.floor((F.col("p") - F.col("last.s")) / F.col("unit"))).otherwise(F.floor((F.col("last.e") - F.col("p") - F.col("unit")) / F.col("unit"))) + 1
    met = kept(met.select("id", "side", "again", "unit", (steps * F.col("unit")).cast("int").alias("by")))
    best = lambda side: F.min(F.when(F.col("side") == side, F.struct("again", "unit", "by")))
    # the text must hold two units: with the end first reached on the left, with the new start on the right
    room = df.join(met.where("side = 'left'"), "id").where(F.col("e0") - F.col("s0") - REACH * F.col("again") + 1 >= 2 * F.col("unit")).groupBy("id").agg(best("left").alias("l"))
    df = df.join(room, "id", "left")
    df = df.withColumn("s1", F.when(F.col("l").isNull(), F.col("s0") + REACH).otherwise(F.greatest(F.col("s0") + REACH * F.col("l.again") - F.col("l.by"), F.lit(0))))
    right = df.select("id", "s1", "e0").join(met.where("side = 'right'"), "id").where(F.col("e0") - REACH * F.col("again") - F.col("s1") + 1 >= 2 * F.col("unit")).groupBy("id").agg(best("right").alias("r"))
    df = df.join(right, "id", "left")
    new_end: Column = F.when(F.col("r").isNull(), F.col("e0") - REACH).otherwise(F.least(F.col("e0") - REACH * F.col("r.again") + F.col("r.by"), F.col("length") - 1))
    return df.select("id", "contig", (F.col("s1") + pad).cast("int").alias("s"), (new_end - pad).cast("int").alias("e"))
