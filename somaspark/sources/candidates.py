"""Tables of candidates and of realigned reads: K7, K8, K9, K11, N11, S12, S13."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somaspark.sources.text import VCF_FIELDS, vcf_lines


def write_candidates(df: DataFrame, path: str, per_file: int = 50_000) -> None:
    """K7, K9: candidates (id and what else they have) by id, at most ``per_file`` a file.

    Ranges of ids make the files' statistics serve as the index."""
    df.repartitionByRange("id").sortWithinPartitions("id").write.option("maxRecordsPerFile", per_file).parquet(path)


def read_candidates(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """All candidates, or those of a short list of ids, pushed down to the files."""
    df = spark.read.parquet(path)
    return df if ids is None else df.where(F.col("id").isin(ids))


def write_sides(df: DataFrame, path: str) -> None:
    """K8: candidates with a type other than NONE under ``var``, others (null too) under ``none``, as records.

    Rows: id, contig, pos, ref, alt, kind, centre, length, tumor_cov, normal_cov; the tag keeps the last ones."""
    tag = F.concat_ws(".", "id", "pos", F.substring("ref", 1, 55), F.substring("alt", 1, 55), F.coalesce("kind", F.lit("NONE")), "centre", "length", "tumor_cov", "normal_cov")
    fields = {"id": F.lit("."), "qual": F.lit(None), "filter": F.lit(None), "info": F.concat(F.lit("TAG="), tag, F.lit(";")), "format": F.lit(None), "sample": F.lit(None)}
    is_var = F.coalesce(F.col("kind") != "NONE", F.lit(False))
    for name, side in (("var", is_var), ("none", ~is_var)):
        rows = df.where(side).select(*[fields.get(c, F.col(c)).alias(c) for c in VCF_FIELDS])
        vcf_lines(rows).write.text(f"{path}/{name}")


def write_reads(df: DataFrame, path: str) -> None:
    """Realigned reads (contig, pos, name, cigar, ...) by contig and place; a contig spreads over tasks
    by ranges of its places."""
    df.repartitionByRange("contig", "pos").sortWithinPartitions("contig", "pos", "name").write.partitionBy("contig").parquet(path)


def excess_ends(df: DataFrame) -> DataFrame:
    """Df with excess_start and excess_end, by how much a read's old ends lie inside its new ones.

    Rows: reference and read (gapped, of one length), region_start, region_end, pos_start, pos_end. A read
    without a base on a base of the reference has the distances from the region's ends."""
    on = F.zip_with(F.split("reference", ""), F.split("read", ""), lambda a, b: (a != "-") & (b != "-"))
    before = lambda text, n: F.length(F.replace(F.substr(text, F.lit(1), n), F.lit("-"))) - 1
    first, last = F.array_position(on, True).cast("int"), F.array_position(F.reverse(on), True).cast("int")
    shift = lambda text, n: F.when(n > 0, before(text, n)).otherwise(0)
    return df.withColumns({
        "excess_start": F.col("pos_start") - F.col("region_start") - shift(F.col("reference"), first),
        "excess_end": F.col("region_end") - F.col("pos_end") - shift(F.reverse("reference"), last),
    })
