"""The count table by place, for look-ups that read few of its files: K2, S10.

Files hold ranges of places, and a small table beside them says which. A look-up joins the places
asked for with that table and reads only the files that can hold one. The list of files is all that
comes to the driver: one row a file, as in any listing of the folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somaspark.operators.intervals import range_join

BIN = 1 << 16


def write_counts(df: DataFrame, path: str, per_file: int = 1_000_000, files: int | None = None) -> None:
    """df (contig, pos and what else it has) under ``path/counts``, by contig and place, at most per_file
    rows a file, and under ``path/index`` each file's contigs with their range of places. files: number
    of ranges to begin with; Spark's own number of shuffle partitions otherwise. Rows without a place go."""
    rows = df.dropna(subset=["contig", "pos"])
    rows = rows.repartitionByRange("contig", "pos") if files is None else rows.repartitionByRange(files, "contig", "pos")
    rows.sortWithinPartitions("contig", "pos").write.option("maxRecordsPerFile", per_file).parquet(f"{path}/counts")
    stored = df.sparkSession.read.schema(df.schema).parquet(f"{path}/counts")
    index = stored.select(F.col("_metadata.file_path").alias("file"), "contig", "pos").groupBy("file", "contig").agg(F.min("pos").alias("s"), (F.max("pos") + 1).alias("e"))
    index.write.parquet(f"{path}/index")


def files_of(spark: SparkSession, path: str, loci: DataFrame, pad: int) -> list[str]:
    """The files that may hold a place at most pad from one of loci (contig, pos)."""
    asked = loci.dropna(subset=["contig", "pos"]).select("contig", (F.col("pos") - pad).alias("s"), (F.col("pos") + pad + 1).alias("e")).distinct()
    hit = range_join(asked, spark.read.parquet(f"{path}/index"), size=BIN)
    return [r.file for r in hit.select(F.col("r_file").alias("file")).distinct().orderBy("file").collect()]


def read_counts(spark: SparkSession, path: str, loci: DataFrame | None = None, pad: int = 0) -> DataFrame:
    """All rows, or those of the files that hold a place at most pad from one of loci (contig, pos), for a
    join with them. Without such a file, no rows."""
    whole = spark.read.parquet(f"{path}/counts")
    if loci is None:
        return whole
    files = files_of(spark, path, loci, pad)
    return spark.read.schema(whole.schema).parquet(*files) if files else whole.where(F.lit(False))
