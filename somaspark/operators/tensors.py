"""Feature matrices and their channels: M1-M15, J11, A24, F18, P17, B4-B6.

A tensor is an array column in row-major order (rows ``-ACGT``, then columns); higher-order functions
work inside each row, so these operators neither shuffle nor leave the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def spine(loci: DataFrame, pad: int, last: int | None = None) -> DataFrame:
    """The positions pos - pad .. pos + pad of each locus, from 1 on: id, contig, at, offset."""
    hi = F.col("pos") + pad if last is None else F.least(F.col("pos") + pad, F.lit(last))
    return loci.select("id", "contig", "pos", F.explode(F.sequence(F.greatest(F.lit(1), F.col("pos") - pad), hi)).alias("at")).withColumn("offset", F.col("at") - F.col("pos"))


def window_matrix(loci: DataFrame, pileup: DataFrame, pad: int, cols: list[str]) -> DataFrame:
    """The pileup columns of each locus' window in order; places without reads are zero."""
    p = pileup.select("contig", F.col("pos").alias("at"), *cols)
    df = spine(loci, pad).join(p, ["contig", "at"], "left")
    cell = F.struct("offset", *[F.coalesce(c, F.lit(0)).alias(c) for c in cols])
    m = df.groupBy("id").agg(F.array_sort(F.collect_list(cell)).alias("m"))
    field = lambda c: F.transform("m", lambda x: x[c]).alias(c)
    return m.select("id", *[field(c) for c in cols])


def filled(m: DataFrame, cols: list[str]) -> DataFrame:
    """M3: a column without any read gets the window's overall maximum in the gap row (the first of cols)."""
    top = F.greatest(*[F.array_max(c) for c in cols])
    empty = F.zip_with(cols[0], F.aggregate(F.array(*[F.col(c) for c in cols[1:]]), F.transform(cols[0], lambda x: x * 0), lambda a, x: F.zip_with(a, x, lambda u, v: u + v)), lambda a, b: (a + b) == 0)
    return m.withColumn("top", top).withColumn("empty", empty).withColumn(cols[0], F.zip_with(cols[0], "empty", lambda x, e: F.when(e, F.lit(None)).otherwise(x))).withColumn(cols[0], F.transform(cols[0], lambda x: F.coalesce(x, F.col("top")))).drop("top", "empty")


def kept_columns(evidence: Column, depth: Column, inserted: Column, share: float = 0.06) -> Column:
    """M4, M15, B6 (rule 1): indices (from 0) of the columns that stay: all reference columns, and
    insertion columns with more evidence than share * depth."""
    flags = F.zip_with(evidence, inserted, lambda e, i: ~i | (e > share * depth))
    return F.filter(F.transform(flags, lambda f, i: F.when(f, i)), lambda x: x.isNotNull())


def centred(x: Column, width: int) -> Column:
    """M5: padded with zeros on both sides to width (one more behind)."""
    gap = F.greatest(F.lit(0), F.lit(width) - F.size(x))
    left = F.floor(gap / 2).cast("int")
    return F.concat(F.array_repeat(F.lit(0.0), left), x.cast("array<double>"), F.array_repeat(F.lit(0.0), gap - left))


def resized(x: Column, width: int) -> Column:
    """M6: linear resampling of a row to width; ends stay ends. Values stay on their own scale (the
    original tool rescales to bytes; that is left out)."""
    n = F.size(x)

    def at(i: Column) -> Column:
        p = i * (n - 1) / F.lit(float(max(1, width - 1)))
        lo = F.floor(p).cast("int")
        hi = F.least(lo + 1, n - 1)
        return F.get(x, lo) + (F.get(x, hi) - F.get(x, lo)) * (p - lo)

    return F.transform(F.sequence(F.lit(0), F.lit(width - 1)), at)


def one_hot(codes: Column, depth: Column, rows: int = 5) -> Column:
    """M7: row-major one-hot rows of the reference, scaled by the column's depth."""
    row = lambda r: F.zip_with(codes, depth, lambda c, d: F.when(c == r, d).otherwise(0))
    return F.flatten(F.array(*map(row, range(rows))))


def centre_column(offsets: Column) -> Column:
    """M8: index of the candidate's own column: the first of offset 0, else the one nearest to it."""
    near = F.array_min(F.transform(offsets, lambda o, i: F.struct(F.abs(o).alias("d"), i.alias("i"))))
    return near["i"]


def normalised(x: Column, limit: Column | float | None = None) -> Column:
    """Bytes 0-255 by a fixed limit or the row's own maximum."""
    top = F.lit(float(limit)) if isinstance(limit, int | float) else F.array_max(x) if limit is None else limit
    return F.transform(x, lambda v: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.coalesce(F.try_divide(v * 255.0, top), F.lit(0.0))).cast("int"))))


def coverage_channels(centre: Column, tumor: Column, normal: Column, width: int, limit: int = 100) -> Column:
    """Centre marker, capped tumor and normal coverage as constant channels, one after another."""
    level = lambda c: F.array_repeat(F.round(F.least(c, F.lit(limit)) / F.lit(float(limit)) * 255, 4), width)
    mark = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.when(i == centre, 255.0).otherwise(0.0))
    return F.concat(mark, level(tumor), level(normal))


def frequency(x: Column, total: Column) -> Column:
    """Element-wise share, 0 where nothing was counted."""
    return F.zip_with(x, total, lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0)))


def input_transform(channels: Column, standard: int = 3) -> Column:
    """To [0, 1]; the first three channels on to [-1, 1]."""
    return F.transform(channels, lambda c, k: F.transform(c, lambda v: F.when(k < standard, (v / 255.0 - 0.5) / 0.5).otherwise(v / 255.0)))


def argmax(x: Column) -> Column:
    """Index of the first largest element, from 0."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def shifted(x: Column, by: Column) -> Column:
    """Rotation by a number of columns, the shift augmentation."""
    n = F.size(x)
    return F.transform(x, lambda _, i: F.get(x, F.pmod(i - by, n)))


def softmax(x: Column) -> Column:
    """Numerically safe."""
    top = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v.cast("double") - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    return F.transform(e, lambda v: v / total)


def dense(x: Column, weights: list[list[float]], bias: list[float]) -> Column:
    """One output a row of weights."""
    dot = lambda w: F.aggregate(F.zip_with(x, F.array(*map(F.lit, w)), lambda a, b: a.cast("double") * b), F.lit(0.0), lambda a, v: a + v)
    return F.array(*[dot(w) + F.lit(b) for w, b in zip(weights, bias, strict=True)])


#: Limits of the annotation groups (fixed values).
GROUPS = {"coverage": (0, 100), "mq": (0, 70), "bq": (0, 41), "nm_diff": (-100, 100), "flag": (0, 1), "rank_z": (-30, 30)}


def scaled(x: Column, lo: float, hi: float) -> Column:
    """clipped to [lo, hi] and moved to [0, 1]."""
    return (F.least(F.greatest(x, F.lit(float(lo))), F.lit(float(hi))) - lo) / (hi - lo)


def covered_enough(df: DataFrame, total: str, least: int = 5) -> DataFrame:
    """P17."""
    return df.where(F.col(total) >= least)
