"""Reference sequences in FASTA files with a line-width index (``.fai``): S7, S8, S18.

The index gives each contig's length, the byte of its first base and the bases and bytes a line; so
the bytes of any stretch of bases are known without reading what lies before. ``read_reference``
deals stretches over tasks, each of which reads its own bytes, and returns chunks of equal length,
to be joined by (contig, start). Every executor must be able to open the path.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

FAI = "contig string, length long, offset long, line_bases long, line_bytes long"
CHUNK, STRETCH = 64, 1 << 18


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """ord and the index's columns, in the file's order."""
    df = spark.read.schema(FAI).csv(path, sep="\t", mode="FAILFAST")
    return df.select(F.row_number().over(Window.orderBy("offset")).cast("int").alias("ord"), "*")  # a row a contig


def byte_of(base: Column) -> Column:
    """The byte at which a base (from 0) of the contig lies."""
    return (F.col("offset") + F.floor(base / F.col("line_bases")) * F.col("line_bytes") + base % F.col("line_bases")).cast("long")


def read_reference(spark: SparkSession, path: str, index: str | None = None, chunk: int = CHUNK, overlap: int = 0, stretch: int = STRETCH, contigs: list[str] | None = None) -> DataFrame:
    """Contig, start, seq (upper case): chunks of ``chunk`` bases and ``overlap`` more, the last of a
    contig shorter. contigs: those wanted; one that the index lacks is an error."""
    stretch -= stretch % chunk
    place = path.removeprefix("file://")
    fai = read_fai(spark, index or path + ".fai").drop("ord")
    if contigs is not None:
        fai = checked(spark.createDataFrame([(c,) for c in contigs], "contig string"), fai)
    parts = fai.where("length > 0").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(stretch).cast("long"))).alias("first"))
    last = F.least(F.col("first") + stretch + overlap, F.col("length")) - 1
    parts = parts.select("contig", "first", (last - F.col("first") + 1).alias("n"), byte_of(F.col("first")).alias("b0"), (byte_of(last) + 1).alias("b1")).repartition("contig", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with open(place, "rb") as f:
            for b in batches:
                for r in b.to_pylist():
                    f.seek(r["b0"])
                    seq = f.read(r["b1"] - r["b0"]).translate(None, b"\r\n").upper().decode()
                    if len(seq) != r["n"]:
                        raise ValueError(f"the index does not fit the file: {r['contig']} at base {r['first']}")
                    own = range(0, min(stretch, len(seq)), chunk)
                    yield pa.RecordBatch.from_arrays([pa.array([r["contig"]] * len(own)), pa.array([r["first"] + i for i in own], pa.int64()), pa.array([seq[i : i + chunk + overlap] for i in own])], ["contig", "start", "seq"])

    return parts.mapInArrow(run, "contig string, start long, seq string")


def checked(rows: DataFrame, contigs: DataFrame) -> DataFrame:
    """Rows with the columns of contigs (one row a contig); an unknown or null contig is an error."""
    names = rows.select("contig").distinct()
    wrong = names.join(contigs, names["contig"].eqNullSafe(contigs["contig"]), "left_anti").take(3)
    if wrong:
        raise ValueError("unknown contig: " + ", ".join(str(r["contig"]) for r in wrong))
    return rows.join(contigs, "contig")


def fetch(intervals: DataFrame, reference: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Intervals (id, contig, s, e half-open) with seq, put together from the chunks they cross. An
    interval past the contig's end gets what is there; an empty one an empty text."""
    first, last = F.floor(F.col("s") / chunk) * chunk, F.floor((F.col("e") - 1) / chunk) * chunk
    need = intervals.select("id", "contig", "s", "e", F.explode(F.when(F.col("e") > F.col("s"), F.sequence(first.cast("long"), last.cast("long"), F.lit(chunk).cast("long")))).alias("start"))
    got = need.join(reference.select("contig", F.col("start").cast("long"), "seq"), ["contig", "start"])
    lo = F.greatest(F.col("s") - F.col("start"), F.lit(0))
    piece = F.substr(F.left("seq", F.lit(chunk)), (lo + 1).cast("int"), (F.least(F.col("e") - F.col("start"), F.lit(chunk)) - lo).cast("int"))
    whole = got.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("start", piece.alias("t")))).alias("p")).select("id", F.array_join(F.col("p")["t"], "").alias("seq"))
    return intervals.join(whole, "id", "left").withColumn("seq", F.coalesce("seq", F.lit("")))


def read_aligned(spark: SparkSession, path: str) -> DataFrame:
    """Name and seq of the records of a FASTA file, gaps kept: rows of an alignment. Records are split
    by Spark's reader; a record is one row, so this is for sequences of a region and not for contigs."""
    df = spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")
    head = F.regexp_extract("value", r"\A\s*(\S*)", 1)
    return df.select(head.alias("name"), F.regexp_replace(F.regexp_replace("value", r"\A[^\n]*\n?", ""), r"\s", "").alias("seq"))
