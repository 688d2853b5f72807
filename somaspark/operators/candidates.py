"""Candidate filters and merges: P6-P9, P14, P16, P22, W1, W7, A7, J6, F13.

Raw records have one base or N on either side: N as REF is an insertion, N as ALT a deletion.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stretches import carried, inside, numbered


def fraction() -> Column:
    """ao / (ro + ao), null without reads."""
    return F.try_divide(F.col("ao").cast("double"), F.col("ro") + F.col("ao"))


def prefilter(df: DataFrame, min_ao: int = 1, max_dp: int = 100000) -> DataFrame:
    """P6, P14, P16."""
    return df.where((F.col("ao") >= F.least(F.col("ro"), F.lit(min_ao))) & (F.col("dp") < max_dp) & (F.col("ref") != F.col("alt")))


def is_snp() -> Column:
    return (F.length("ref") == 1) & (F.length("alt") == 1)


def snps(df: DataFrame, min_af: float = 0.05, min_ao: int = 3, min_bq: int = 10, min_dp: int = 5, max_dp: int = 100000) -> DataFrame:
    """P7."""
    deep = (F.col("dp") > min_dp) & (F.col("dp") < max_dp)
    return df.where(is_snp() & deep & ((fraction() >= min_af) | (F.col("ao") >= min_ao)) & (F.col("bq") >= min_bq))


def insertions(df: DataFrame, min_af: float = 0.05, good_ao: int = 10, min_dp: int = 5) -> DataFrame:
    """An insertion goes with low fraction and few reads, or at a depth of min_dp or less."""
    low = (F.coalesce(fraction(), F.lit(0.0)) < min_af) & (F.col("ao") < good_ao)
    return df.where((F.length("alt") > F.length("ref")) & ~low & (F.col("dp") > min_dp))


def best_of_locus(df: DataFrame) -> DataFrame:
    """Of records with one contig, pos, ref, alt the one of the largest ao / (ro + 1e-4)."""
    ratio = F.col("ao") / (F.col("ro") + 1e-4)
    w = Window.partitionBy("contig", "pos", "ref", "alt").orderBy(ratio.desc(), "id")
    return df.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def deletion_runs(df: DataFrame, min_af: float = 0.0, good_ao: int = 10, most: int = 256) -> DataFrame:
    """Deleted bases at neighbouring positions become one deletion; attributes take their maximum.

    Rows: contig, pos, base, ao, ro. Runs are found within stretches of a contig and joined at the
    stretch ends, so that no window holds a whole contig."""
    kept = df.where((F.coalesce(fraction(), F.lit(0.0)) >= min_af) | (F.col("ao") >= good_ao)).withColumn("stretch", F.floor(F.col("pos") / most))
    w = Window.partitionBy("contig", "stretch").orderBy("pos")
    runs = kept.withColumn("run", F.col("pos") - F.row_number().over(w)).groupBy("contig", "stretch", "run")
    parts = runs.agg(F.min("pos").alias("s"), (F.max("pos") + 1).alias("e"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "base"))), lambda x: x["base"]), "").alias("bases"), F.max("ao").alias("ao"), F.max("ro").alias("ro"))
    order = Window.partitionBy("contig").orderBy("s")
    parts = parts.withColumn("new", F.when(F.lag("e").over(order) == F.col("s"), 0).otherwise(1)).withColumn("island", F.sum("new").over(order))
    return parts.groupBy("contig", "island").agg(F.min("s").alias("pos"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("s", "bases"))), lambda x: x["bases"]), "").alias("ref"), F.max("ao").alias("ao"), F.max("ro").alias("ro")).drop("island")


#: What a merged record takes the largest value of (depth, counts, mapping and base quality, strands, clips, tags).
ATTRIBUTES = ("dp", "ro", "ao", "mq", "bq", "st1", "st2", "ls", "rs", "nm", "as_", "xs", "pr", "cl")


def _merged(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """One record a group: the largest attributes, the first place, the texts joined in order (pos, id)."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "id", F.col(text).alias("t"))))
    return rows.groupBy(*keys).agg(F.min("pos").alias("at"), F.array_join(F.transform(parts, lambda x: x["t"]), "").alias(text), *[F.max(c).alias(c) for c in ATTRIBUTES])


def merged_insertions(df: DataFrame, min_af: float = 0.05, merge_min_af: float = 0.0, good_ao: int = 10, merge_r: float = 0.5) -> DataFrame:
    """The insertions of one place become one: those under merge_r of the largest fraction go,
    the others' bases are joined in order of id. A merged record needs a largest fraction of
    merge_min_af or good_ao reads; a lone one min_af or good_ao reads, and a depth above 5.

    Rows: id, contig, pos, ref, alt and ATTRIBUTES; so are the results, without id."""
    af = F.coalesce(fraction(), F.lit(0.0))
    place = Window.partitionBy("contig", "pos")
    rows = df.where("ref = 'N'").withColumns({"af": af, "top": F.max(af).over(place), "n": F.count("*").over(place)})
    lone = rows.where("n = 1").where(((F.col("af") >= min_af) | (F.col("ao") >= good_ao)) & (F.col("dp") > 5))
    many = _merged(rows.where((F.col("n") > 1) & (F.col("af") >= F.col("top") * merge_r)), ["contig", "pos", "top"], "alt")
    many = many.where((F.col("top") >= merge_min_af) | (F.col("ao") >= good_ao)).withColumn("ref", F.lit("N"))
    cols = ["contig", "pos", "ref", "alt", *ATTRIBUTES]
    return lone.select(*cols).unionByName(many.select(*cols))


def merged_deletions(df: DataFrame, ins: DataFrame, min_af: float = 0.05, merge_min_af: float = 0.0, good_ao: int = 10, merge_r: float = 0.5, min_dp: int = 5, max_dp: int = 100000) -> DataFrame:
    """Deleted bases at neighbouring places become one deletion.

    Bases within the depth bounds and of merge_min_af or good_ao reads take part. A run ends before a
    place without a deletion and before a place with an SNP record or an insertion of ins. Of longer
    runs the bases under merge_r of the largest fraction go; a lone base needs min_af or, where what
    ends its run is an SNP, an insertion or the contig's end, good_ao reads. Rows as for insertions."""
    af = F.coalesce(fraction(), F.lit(0.0))
    deep = (F.col("dp") > min_dp) & (F.col("dp") < max_dp)
    dels = df.where((F.col("ref") != "N") & (F.col("alt") == "N") & deep).withColumn("af", af).where((F.col("af") >= merge_min_af) | (F.col("ao") >= good_ao))
    stops = df.where("ref <> 'N' and alt <> 'N'").select("contig", "pos").union(ins.select("contig", "pos")).distinct()
    before = dels.select("contig", (F.col("pos") + 1).alias("pos"), F.lit(True).alias("follows")).distinct()
    rows = dels.join(stops.withColumn("stop", F.lit(True)), ["contig", "pos"], "left").join(before, ["contig", "pos"], "left")
    rows = rows.withColumn("start", F.when(F.col("stop").isNotNull() | F.col("follows").isNull(), F.col("pos"))).drop("follows", "stop")
    events = rows.withColumn("at_stop", F.lit(None).cast("int")).unionByName(stops.withColumn("at_stop", F.col("pos")), allowMissingColumns=True)
    events = events.withColumn("at_del", F.when(F.col("id").isNotNull(), F.col("pos")))
    events = carried(events, ["contig"], F.shiftright("pos", 16), before={"start0": (F.max, "start")}, after={"stop1": (F.min, "at_stop"), "del1": (F.min, "at_del")})
    w = inside(["contig"], "pos")
    ahead = w.rangeBetween(1, Window.unboundedFollowing)
    run = F.coalesce(F.max("start").over(w.rangeBetween(Window.unboundedPreceding, 0)), F.col("start0"))
    next_stop, next_del = (F.coalesce(F.min(c).over(ahead), F.col(later)) for c, later in (("at_stop", "stop1"), ("at_del", "del1")))
    events = events.withColumns({"run": run, "stopped": next_del.isNull() | F.coalesce(next_stop <= next_del, F.lit(False))}).where("id is not null")
    whole = Window.partitionBy("contig", "run")
    rows = events.withColumns({"top": F.max("af").over(whole), "n": F.count("*").over(whole)})
    lone = rows.where("n = 1").where((F.col("af") >= min_af) | (F.col("stopped") & (F.col("ao") >= good_ao)))
    many = _merged(rows.where((F.col("n") > 1) & (F.col("af") >= F.col("top") * merge_r)), ["contig", "run"], "ref").withColumnRenamed("at", "pos").withColumn("alt", F.lit("N"))
    cols = ["contig", "pos", "ref", "alt", *ATTRIBUTES]
    return lone.select(*cols).unionByName(many.select(*cols))


def without_known(df: DataFrame, known: DataFrame, strict: bool = False) -> DataFrame:
    """Drops known variants. A record stays if nothing is known at its place or something else
    is known there too; ``strict`` drops every exact match."""
    k = known.groupBy("contig", "pos").agg(F.collect_set(F.struct("ref", "alt")).alias("known"))
    df = df.join(k, ["contig", "pos"], "left")
    own = F.struct("ref", "alt")
    keep = ~F.array_contains("known", own) if strict else F.exists("known", lambda x: x != own)
    return df.where(F.col("known").isNull() | keep).drop("known")


def info_text(cols: dict[str, str]) -> Column:
    """KEY=value pairs of the columns that are not null."""
    return F.concat_ws(";", *[F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{k}="), F.col(c).cast("string"))) for k, c in cols.items()])


def info_value(info: str | Column, key: str, kind: str, default=None) -> Column:
    """a typed value of an INFO text."""
    return F.coalesce(F.str_to_map(info, F.lit(";"), F.lit("="))[key].try_cast(kind), F.lit(default).cast(kind))


def placed(df: DataFrame, by: str) -> DataFrame:
    """Df with place, its number (from 1) in the order of by, pos, id. Numbers run on from one
    value of by to the next; within one they are given stretch by stretch."""
    per = df.groupBy(by).agg(F.count("*").alias("_n"))  # a row a contig
    base = per.select(by, F.coalesce(F.sum("_n").over(Window.orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return numbered(df.join(base, by), [by], F.shiftright("pos", 16), "pos", "id").withColumn("place", F.col("_base") + F.col("k") + 1).drop("k", "_base")
