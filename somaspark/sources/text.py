"""Text tables: BED, VCF, count files and annotation TSVs.

Files are split and parsed by Spark's own readers. Malformed rows are kept apart, not guessed:
``read_vcf`` fails on a record that has not ten fields unless told to drop it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BED = "contig string, s int, e int"
VCF_FIELDS = ("contig", "pos", "id", "ref", "alt", "qual", "filter", "info", "format", "sample")
#: The calls' header lines (fixed values of the format).
VCF_HEADER = (
    "##fileformat=VCFv4.2",
    '##FILTER=<ID=PASS,Description="Accepted">',
    '##FILTER=<ID=LowQual,Description="Less confident">',
    '##FILTER=<ID=REJECT,Description="Rejected">',
    '##INFO=<ID=SCORE,Number=1,Type=Float,Description="Probability">',
    '##INFO=<ID=DP,Number=1,Type=Integer,Description="Depth">',
    '##INFO=<ID=RO,Number=1,Type=Integer,Description="Reference reads">',
    '##INFO=<ID=AO,Number=1,Type=Integer,Description="Alternative reads">',
    '##INFO=<ID=AF,Number=1,Type=Float,Description="Alternative fraction">',
    '##FORMAT=<ID=GT,Number=1,Type=String,Description="Genotype">',
)


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Ends in either order."""
    df = spark.read.schema(BED).option("comment", "#").csv(path, sep="\t")
    return df.select("contig", F.least("s", "e").alias("s"), F.greatest("s", "e").alias("e"))


def write_bed(df: DataFrame, path: str, split: str | None = None) -> None:
    """One folder, or one a value of ``split``."""
    w = df.select("contig", "s", "e", *([split] if split else [])).write
    (w.partitionBy(split) if split else w).csv(path, sep="\t")


def read_vcf(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Records as VCF_FIELDS; pos int, qual double (null for '.')."""
    rows = spark.read.text(path).where(~F.col("value").startswith("#") & (F.trim("value") != "")).select(F.split("value", r"\s+").alias("x"))
    n = F.size("x") == len(VCF_FIELDS)
    rows = rows.withColumn("x", F.when(n, F.col("x")).otherwise(F.raise_error(F.concat(F.lit("not ten fields: "), F.array_join("x", " "))))) if strict else rows.where(n)
    df = rows.select(*[F.get("x", F.lit(i)).alias(c) for i, c in enumerate(VCF_FIELDS)])
    return df.withColumns({"pos": F.col("pos").cast("int"), "qual": F.col("qual").try_cast("double")})


def vcf_lines(df: DataFrame) -> DataFrame:
    text = [F.coalesce(F.col(c).cast("string"), F.lit(".")) for c in VCF_FIELDS]
    return df.select(F.concat_ws("\t", *text).alias("value"))


def write_vcf(df: DataFrame, path: str, contigs: DataFrame | None = None) -> None:
    """K1, K3-K5: a sorted body in the order of file names, the header in a first file of its own, so
    that concatenating the files in name order gives one valid file. df has ``ord`` for the order."""
    spark = df.sparkSession
    lines = list(VCF_HEADER)
    if contigs is not None:  # a line a contig
        lines += [f"##contig=<ID={r['name']},length={r['len']}>" for r in contigs.orderBy("ord").select("name", "len").collect()]
    lines.append("#" + "\t".join(("CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", "SAMPLE")))
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(f"{path}/header")
    vcf_lines(df.orderBy("ord", "pos")).write.text(f"{path}/body")


def write_predictions(df: DataFrame, path: str, least: float = 0.0, contigs: DataFrame | None = None) -> None:
    """K4: records whose ``score`` is at least ``least``, each line once, in order; a null score is below.

    Rows: VCF_FIELDS, ord, score."""
    write_vcf(df.where(F.col("score") >= least).select(*VCF_FIELDS, "ord").distinct(), path, contigs)


def read_annotations(spark: SparkSession, path: str, features: list[str]) -> DataFrame:
    """Columns by header name, a missing one is an error; true/false become 1/0; end = pos + len(ref)."""
    df = spark.read.option("header", True).csv(path, sep="\t")
    if missing := [c for c in ("CHROM", "POS", "REF", "ALT", *features) if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    number = lambda c: F.when(F.lower(c) == "true", 1.0).when(F.lower(c) == "false", 0.0).otherwise(F.nanvl(F.col(c).try_cast("double"), F.lit(0.0)))
    pos = F.col("POS").cast("int")
    return df.select(F.col("CHROM").alias("contig"), pos.alias("pos"), (pos + F.length("REF")).alias("end"), F.col("REF").alias("ref"), F.col("ALT").alias("alt"), *[number(f"`{c}`").alias(c) for c in features])


def count_line(df: DataFrame, vectors: list[str]) -> DataFrame:
    """Contig, pos, pos + 1, reference base and the vectors, each joined by ':'."""
    base = F.substr(F.lit("-ACGT"), F.col("refcode") + 1, F.lit(1))
    return df.select(F.concat_ws("\t", "contig", "pos", F.col("pos") + 1, base, *[F.array_join(F.transform(v, lambda x: x.cast("string")), ":") for v in vectors]).alias("value"))
