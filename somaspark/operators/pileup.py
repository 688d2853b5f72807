"""Pileup aggregation over base rows (contig, pos, code, ...): A1-A6, P20, P21, W17, M2.

Codes follow the storage order gap 0, A 1, C 2, G 3, T 4. All work is one map-side combined
aggregation per locus; the five counts stay columns, so no pivot and no second shuffle is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LOCUS = ("contig", "pos")
CODES = range(5)
#: The order in which equal counts are preferred: A, C, G, T, gap.
PREFERENCE = (1, 2, 3, 4, 0)


def counts(bases: DataFrame, keys: tuple[str, ...] = LOCUS) -> DataFrame:
    """A1: c0..c4, the bases of each code at each locus, and the reference code."""
    return bases.groupBy(*keys).agg(F.max("refcode").alias("refcode"), *[F.count(F.when(F.col("code") == c, 1)).alias(f"c{c}") for c in CODES])


def depth(df: DataFrame) -> DataFrame:
    """A4: depth over all five codes and over bases alone."""
    return df.withColumns({"depth": sum(F.col(f"c{c}") for c in CODES), "base_depth": sum(F.col(f"c{c}") for c in CODES if c)})


def qualities(bases: DataFrame, keys: tuple[str, ...] = LOCUS) -> DataFrame:
    """A2: mean base and mapping quality and the forward share in percent, per locus and code."""
    mean = lambda c, k=1: F.round(k * F.sum(c).cast("double") / F.count("*"), 4)
    return bases.groupBy(*keys, "code").agg(F.count("*").alias("n"), mean("bq").alias("bq"), mean("mapq").alias("mapq"), mean("fwd", 100).alias("strand"))


def clips(bases: DataFrame, keys: tuple[str, ...] = LOCUS, swapped: bool = False) -> DataFrame:
    """Soft-clip counts at each locus; ``swapped`` exchanges the sides as the original tool does."""
    left, right = ("rclip", "lclip") if swapped else ("lclip", "rclip")
    return bases.groupBy(*keys).agg(F.sum(left).alias("ls"), F.sum(right).alias("rs"))


def ranked_codes() -> Column:
    """The codes as structs (n, code), most frequent first, ties by PREFERENCE."""
    return F.array_sort(F.array(*[F.struct((-F.col(f"c{c}")).alias("minus"), F.lit(i).alias("place"), F.lit(c).alias("code"), F.col(f"c{c}").alias("n")) for i, c in enumerate(PREFERENCE)]))


def major_minor(df: DataFrame) -> DataFrame:
    """P20: major and minor code of each locus. Under a reference major, a gap minor gives way to a
    second minor of more than half its count, unless the reference itself is a gap."""
    df = df.withColumn("ranked", ranked_codes())
    major, minor, second = (F.col("ranked")[i] for i in range(3))
    swap = (major["code"] == F.col("refcode")) & (minor["code"] == 0) & (F.col("refcode") != 0) & (second["n"] > 0.5 * minor["n"])
    pick = lambda f: F.when(swap, second[f]).otherwise(minor[f])
    return df.select("*", major["code"].alias("major"), major["n"].alias("major_n"), pick("code").alias("minor"), pick("n").alias("minor_n")).drop("ranked")


def raw_candidates(df: DataFrame, min_af: float = 0.01) -> DataFrame:
    """The alternative code, DP, RO, AO and AF of the loci that call for one."""
    df = major_minor(depth(df))
    alt = F.when(F.col("major") != F.col("refcode"), F.col("major")).when((F.col("minor_n") > 0) & (F.col("minor_n").cast("double") / (F.col("major_n") + F.col("minor_n")) > min_af), F.col("minor"))
    at = lambda code: F.element_at(F.array(*[F.col(f"c{c}") for c in CODES]), code + 1)
    df = df.withColumn("alt", alt).where(F.col("alt").isNotNull() & (F.col("alt") != F.col("refcode")))
    df = df.withColumns({"ro": at(F.col("refcode")), "ao": at(F.col("alt"))})
    return df.select("contig", "pos", "refcode", "alt", F.col("depth").alias("dp"), "ro", "ao", F.round(F.col("ao").cast("double") / (F.col("ao") + F.col("ro")), 4).alias("af"))


def snp_calls(df: DataFrame, min_af: float = 0.05, min_ao: int = 3, min_dp: int = 2, max_dp: int = 100000) -> DataFrame:
    """The SNP rule on raw candidates of a pileup; gaps on either side are no SNP."""
    return df.where((F.col("alt") > 0) & (F.col("refcode") > 0) & (F.col("dp") > min_dp) & (F.col("dp") < max_dp) & ((F.col("af") >= min_af) | (F.col("ao") >= min_ao)))


def capped(bases: DataFrame, most: int, order: list[str], keys: tuple[str, ...] = LOCUS) -> DataFrame:
    """The first ``most`` rows of each locus (the feature itself is a cap)."""
    return bases.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= most)


def strand_counts(q: DataFrame) -> DataFrame:
    """M2: forward counts from the forward percentage."""
    return q.withColumn("fwd_n", F.round(F.col("strand") / 100 * F.col("n"), 4))


def aligned_samples(tumor: DataFrame, normal: DataFrame) -> DataFrame:
    """Both samples over all loci; a side without the locus has its overall maximal depth in the gap row."""
    peak = lambda df: df.agg(F.max(F.greatest(*[f"c{c}" for c in CODES])).alias("peak"))
    side = lambda df, p: depth(df).select(*LOCUS, *[F.col(f"c{c}").alias(f"{p}{c}") for c in CODES])
    both = side(tumor, "t").join(side(normal, "n"), list(LOCUS), "full_outer")
    both = both.join(F.broadcast(peak(tumor).withColumnRenamed("peak", "tp")), F.lit(True)).join(F.broadcast(peak(normal).withColumnRenamed("peak", "np")), F.lit(True))  # one row each
    fill = lambda p, c: F.coalesce(f"{p}{c}", F.col(f"{p}p") if c == 0 else F.lit(0))
    return both.select(*LOCUS, *[fill(p, c).alias(f"{p}{c}") for p in "tn" for c in CODES])
