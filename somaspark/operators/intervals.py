"""Interval algebra on half-open (contig, s, e) rows: D1-D4, S1-S3, P2-P5, J1-J5, A8-A12, A23, F19, U3.

Range joins are binned: both sides are spread over fixed-size bins, joined on (contig, bin) and kept
in the first bin they share, so no pair is made twice and no contig becomes one task. Rows of one
place meet as arrays of at most ``COPIES`` and are spread out after the join. Runs of
overlapping intervals are found with a running maximum of the ends, stretch by stretch.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stretches import carried, inside, kept, up_to

BIN = 64
STRETCH = 1 << 16  # a power of two
COPIES = 256
TASKS = 16  # for a core, where copies are spread out
PLACE = ["contig", "s", "e"]


def normalised(df: DataFrame, begin: str = "s", end: str = "e") -> DataFrame:
    """Both orders of the ends are accepted; the smaller one becomes the start."""
    return df.withColumns({begin: F.least(begin, end), end: F.greatest(begin, end)})


def slop(df: DataFrame, k: int, length: Column | str | None = None) -> DataFrame:
    """widened by k on both sides, within [0, length]."""
    end = F.col("e") + k
    return df.withColumns({"s": F.greatest(F.lit(0), F.col("s") - k), "e": F.least(end, F.col(length) if isinstance(length, str) else length) if length is not None else end})


def tile(df: DataFrame, window: int) -> DataFrame:
    """Cut into windows; a tail shorter than one window belongs to the last window."""
    n = F.greatest(F.lit(1), F.floor((F.col("e") - F.col("s")) / window)).cast("int")
    df = df.withColumn("n_tiles", n).withColumn("tile", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)))
    start = F.col("s") + F.col("tile") * window
    return df.withColumns({"tile_s": start.cast("int"), "tile_e": F.when(F.col("tile") == F.col("n_tiles") - 1, F.col("e")).otherwise(start + window).cast("int")}).drop("n_tiles")


def overlaps(a: str, b: str, pad: int = 0) -> Column:
    """Strict overlap of the intervals in structs or aliases a and b, after padding a."""
    return (F.col(f"{a}.contig") == F.col(f"{b}.contig")) & (F.col(f"{a}.s") - pad < F.col(f"{b}.e")) & (F.col(f"{b}.s") < F.col(f"{a}.e") + pad)


def contained(a: str, b: str) -> Column:
    return (F.col(f"{a}.contig") == F.col(f"{b}.contig")) & (F.col(f"{a}.s") >= F.col(f"{b}.s")) & (F.col(f"{a}.e") <= F.col(f"{b}.e"))


def near_start(a: str, b: str, wiggle: int) -> Column:
    """A begins within wiggle of b's start."""
    return F.abs(F.col(f"{a}.s") - F.col(f"{b}.s")) <= wiggle


def near_end(a: str, b: str, wiggle: int) -> Column:
    return F.abs(F.col(f"{a}.e") - F.col(f"{b}.e")) <= wiggle


def _binned(df: DataFrame, first: Column, last: Column, size: int) -> DataFrame:
    """bin (one row a bin) and bin0, the first bin; size is a power of two."""
    lo, hi = (F.shiftright(x, size.bit_length() - 1) for x in (first, last))
    return df.withColumn("bin0", lo).withColumn("bin", F.explode(F.sequence(lo, F.greatest(lo, hi))))


def bin_size(left: DataFrame, right: DataFrame, pad: int = 0) -> int:
    """The power of two next above the mean padded length of both sides' rows, 16 at least: a row then
    falls into two bins or so. One aggregation over the inputs."""
    both = left.select((F.col("e") - F.col("s") + 2 * pad).alias("n")).union(right.select(F.col("e") - F.col("s")))
    return max(16, 1 << math.ceil(both.agg(F.avg("n")).first()[0] or 1).bit_length())


def _gathered(df: DataFrame, name: str, most: int) -> DataFrame:
    """contig, s, e and the array ``name`` of the other columns of at most ``most`` rows of one place; of
    one other column, its values."""
    rest = [c for c in df.columns if c not in PLACE]
    part = F.row_number().over(Window.partitionBy(*PLACE).orderBy(F.lit(0))) - 1
    df = df.select(*PLACE, F.struct(*rest or [F.lit(1)]).alias("x"), F.floor(part / most).alias("part")).groupBy(*PLACE, "part").agg(F.collect_list("x").alias("xs"))
    return df.select(*PLACE, (F.col("xs")[rest[0]] if len(rest) == 1 else F.col("xs")).alias(name))


def _dealt(df: DataFrame, *keys: str) -> DataFrame:
    """Rows by bin in many more tasks than cores. AQE keeps the number: it would merge tasks by what they
    read, down to a few more than there are cores, while their work is the pairs they make."""
    spark = df.sparkSession
    tasks = max(TASKS * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, *keys)


def range_join(left: DataFrame, right: DataFrame, pad: int = 0, size: int = BIN, strategy: str = "binned", copies: int = COPIES) -> DataFrame:
    """Inner join of overlapping rows after padding the left ones by pad.

    Columns of right get the prefix ``r_``. Only distinct places are compared; their copies, ``copies``
    at most in a row, are spread out afterwards; with 1, rows meet as they are, which is cheaper where
    places have few copies. strategy 'auto' takes the bins' size from the data;
    'plain' leaves the range as a residual condition of the contig join: cheaper while one side is small
    enough to be broadcast."""
    size = bin_size(left, right, pad) if strategy == "auto" else size
    meet = (F.col("s") - pad < F.col("r_e")) & (F.col("r_s") < F.col("e") + pad)
    prefixed = lambda df: df.select(*[F.col(c).alias(f"r_{c}") for c in df.columns])
    if strategy == "plain":
        return left.join(prefixed(right), (F.col("contig") == F.col("r_contig")) & meet)
    if copies == 1:
        return _met(left, prefixed(right), pad, size, meet)
    df = _met(_gathered(left, "_l", copies), prefixed(_gathered(right, "l", copies)), pad, size, meet, _dealt)
    df = df.withColumn("_l", F.explode("_l")).withColumn("r_l", F.explode("r_l"))

    def spread(cols: list[str], lead: str, row: str) -> list[Column]:
        one = len([c for c in cols if c not in PLACE]) == 1
        return [F.col(lead + c if c in PLACE else row if one else f"{row}.{c}").alias(lead + c) for c in cols]

    return df.select(*spread(left.columns, "", "_l"), *spread(right.columns, "r_", "r_l"))


def _met(left: DataFrame, right: DataFrame, pad: int, size: int, meet: Column, deal: Callable[..., DataFrame] = lambda df, *keys: df) -> DataFrame:
    a = _binned(left, F.col("s") - pad, F.col("e") + pad - 1, size)
    b = _binned(right, F.col("r_s"), F.col("r_e") - 1, size).withColumnsRenamed({"bin": "r_bin", "bin0": "r_bin0"})
    df = deal(a, "contig", "bin").join(deal(b, "r_contig", "r_bin"), (F.col("contig") == F.col("r_contig")) & (F.col("bin") == F.col("r_bin")))
    return df.where(meet & (F.col("bin") == F.greatest("bin0", "r_bin0"))).drop("bin", "bin0", "r_bin", "r_bin0")


def _places(left: DataFrame, right: DataFrame, pad: int, size: int) -> DataFrame:
    """The distinct places of left that overlap a row of right."""
    meet = (F.col("s") - pad < F.col("r_e")) & (F.col("r_s") < F.col("e") + pad)
    right = right.select(*[F.col(c).alias(f"r_{c}") for c in PLACE]).distinct()
    return _met(left.select(*PLACE).distinct(), right, pad, size, meet).select(*PLACE).distinct()


def range_semi(left: DataFrame, right: DataFrame, key: str = "id", pad: int = 0, size: int = BIN) -> DataFrame:
    """Left rows (unique key) with an overlapping right row."""
    return left.join(_places(left, right, pad, size), PLACE, "left_semi")


def range_anti(left: DataFrame, right: DataFrame, key: str = "id", pad: int = 0, size: int = BIN) -> DataFrame:
    """J4."""
    return left.join(_places(left, right, pad, size), PLACE, "left_anti")


def clip(left: DataFrame, right: DataFrame) -> DataFrame:
    """The common part of each overlapping pair."""
    return range_join(left, right).withColumns({"cs": F.greatest("s", "r_s"), "ce": F.least("e", "r_e")})


def islands(df: DataFrame, gap: int = 0, by: tuple[str, ...] = ("contig",), size: int = STRETCH) -> DataFrame:
    """df with ``island``, numbered within ``by``: rows whose distance to all before exceeds gap begin one."""
    keys, stretch = list(by), F.shiftright("s", size.bit_length() - 1)
    df = carried(df, keys, stretch, before={"_reach": (F.max, "e")})
    w = up_to(inside(keys, "s", "e"), -1)
    reach = F.greatest(F.max("e").over(w), F.col("_reach"))
    df = df.withColumn("_new", F.when(reach.isNull() | (F.col("s") > reach + gap), 1).otherwise(0)).drop("_reach")
    df = carried(df, keys, stretch, before={"_n": (F.sum, "_new")})
    ties = inside(keys, "s", "e").rangeBetween(Window.unboundedPreceding, Window.currentRow)  # equal rows get one number
    number = F.sum("_new").over(ties) + F.coalesce("_n", F.lit(0))
    return df.withColumn("island", number).drop("_new", "_n", "stretch")


def merge(df: DataFrame, gap: int = 0, by: tuple[str, ...] = ("contig",), size: int = STRETCH) -> DataFrame:
    """Union of the intervals; book-ended ones and those within gap merge. n: their number.

    Exact copies are counted first."""
    df = df.groupBy(*by, "s", "e").agg(F.count("*").alias("n"))
    return islands(df, gap, by, size).groupBy(*by, "island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.sum("n").alias("n")).drop("island")


def coverage(df: DataFrame, size: int = STRETCH) -> DataFrame:
    """Depth of every covered piece between two break points, by a sweep over starts and ends."""
    steps = df.select("contig", F.col("s").alias("p"), F.lit(1).alias("d")).union(df.select("contig", "e", F.lit(-1)))
    steps = steps.groupBy("contig", "p").agg(F.sum("d").alias("d"))
    steps = carried(steps, ["contig"], F.shiftright("p", size.bit_length() - 1), before={"base": (F.sum, "d")}, after={"next": (F.min, "p")})
    w = inside(["contig"], "p")
    sweep = steps.withColumn("depth", F.coalesce("base", F.lit(0)) + F.sum("d").over(up_to(w))).withColumn("to", F.coalesce(F.lead("p").over(w), "next"))
    return sweep.where("depth > 0").select("contig", F.col("p").alias("s"), F.col("to").alias("e"), "depth")


def disjoint(df: DataFrame) -> DataFrame:
    """A10: the covered pieces between all break points."""
    return coverage(df).select("contig", "s", "e")


def total_length(df: DataFrame) -> DataFrame:
    """Sum of inclusive lengths."""
    return df.agg(F.sum(F.col("e") - F.col("s") + 1).cast("long").alias("total"))


def split_regions(df: DataFrame, parts: int) -> DataFrame:
    """Merged regions dealt whole to parts by cumulative length (``cut_regions`` cuts them); equal work a part.

    Running sums go contig by contig; only one row a contig meets in one task."""
    merged = merge(df).select("contig", "s", "e", (F.col("e") - F.col("s")).cast("long").alias("size"))
    by = merged.groupBy("contig").agg(F.sum("size").alias("t"))
    base = by.withColumn("base", F.coalesce(F.sum("t").over(Window.orderBy("contig").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("t").over(Window.partitionBy()))
    run = F.coalesce(F.sum("size").over(Window.partitionBy("contig").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    df = merged.withColumn("run", run).join(F.broadcast(base.select("contig", "base", "all")), "contig")  # a row a contig
    return df.select("contig", "s", "e", F.expr(f"cast(least({parts - 1}, ((base + run) * {parts}) div all) as int)").alias("part"))


def cut_regions(df: DataFrame, parts: int, longest: int = 1_000_000, shortest: int = 20) -> DataFrame:
    """Contig, s, e (both ends inclusive), part: merged regions cut into parts of about equal length.

    Regions over ``longest`` are cut first. A part ends where its length is reached; a piece or a rest of
    a region under twice ``shortest`` is not cut off: the piece grows, or takes the rest. A last part
    under half a length joins the one before. The regions stay distributed: a cut depends on the one
    before, so each is one look-up of the region it falls into, ``parts`` (a parameter) in all. No
    region gives no row; fewer bases than parts, one base a part at least."""
    merged = merge(df).select("contig", "s", "e")
    pieces = merged.select("contig", F.explode(F.sequence("s", "e", F.lit(longest))).alias("p"), "s", "e").where((F.col("e") - F.col("s") + 1 > longest) | (F.col("p") == F.col("s")))
    whole = F.col("e") - F.col("s") + 1 <= longest
    pieces = pieces.select("contig", F.col("p").alias("s"), F.when(whole, F.col("e")).otherwise(F.least("e", F.col("p") + longest - 1)).alias("e"))
    pieces = pieces.withColumn("size", (F.col("e") - F.col("s") + 1).cast("long"))
    by = pieces.groupBy("contig").agg(F.sum("size").alias("t"))  # a row a contig
    base = by.select("contig", F.coalesce(F.sum("t").over(Window.orderBy("contig").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    pieces = carried(pieces, ["contig"], F.shiftright("s", STRETCH.bit_length() - 1), before={"ahead": (F.sum, "size")})
    run = F.coalesce("ahead", F.lit(0)) + F.coalesce(F.sum("size").over(up_to(inside(["contig"], "s"), -1)), F.lit(0))
    pieces = kept(pieces.withColumn("run", run).join(base, "contig").select("contig", "s", "e", (F.col("base") + F.col("run")).alias("c0"), (F.col("base") + F.col("run") + F.col("size")).alias("c1")))
    total = pieces.agg(F.max("c1")).first()[0] or 0
    at, want, cuts = 0, max(1, total // parts), [0]
    while at + want <= total:
        r = pieces.where((F.col("c0") < at + want) & (F.col("c1") >= at + want)).first()
        begin = max(r["c0"], at)
        stop = at + want
        if stop - begin < 2 * shortest:
            stop = min(begin + 2 * shortest, r["c1"])
        if r["c1"] - stop < 2 * shortest:
            stop = r["c1"]
        at = stop
        cuts.append(at)
        if want < total - at < 1.5 * want:
            want = total - at
    ends = cuts[1:] + ([total] if at < total else [])
    bounds = F.array(*[F.struct(F.lit(lo).cast("long").alias("lo"), F.lit(hi).cast("long").alias("hi"), F.lit(k).alias("part")) for k, (lo, hi) in enumerate(zip(cuts, ends))])
    if not ends:
        return pieces.select("contig", "s", "e", F.lit(0).alias("part")).where("false")
    met = pieces.select("*", F.explode(F.filter(bounds, lambda b: (b["lo"] < F.col("c1")) & (b["hi"] > F.col("c0")))).alias("b"))
    s = F.col("s") + F.greatest("b.lo", "c0") - F.col("c0")
    e = F.col("s") + F.least("b.hi", "c1") - F.col("c0") - 1
    return met.select("contig", s.cast("int").alias("s"), e.cast("int").alias("e"), "b.part")
