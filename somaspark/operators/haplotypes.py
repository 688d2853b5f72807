"""Haplotypes of groups of overlapping variants, stitched over the reference: D8, F7."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from somaspark.operators.calls import hull_bases
from somaspark.operators.intervals import islands
from somaspark.operators.stretches import kept


def stitched(edits: Column, s: Column, seq: Column) -> Column:
    """struct (seq, skipped): seq, the reference from s on, with edits, an array of (s, e, alt) in order,
    put in: [s, e) becomes alt. An edit that begins before the end of one put in is skipped and counted."""
    start = F.struct(s.cast("int").alias("at"), F.lit("").alias("seq"), F.lit(0).alias("skipped"))

    def put(acc: Column, x: Column) -> Column:
        made = F.concat(acc["seq"], F.substr(seq, acc["at"] - s + 1, F.greatest(x["s"] - acc["at"], F.lit(0))), x["alt"])
        late = F.struct(acc["at"].alias("at"), acc["seq"].alias("seq"), (acc["skipped"] + 1).alias("skipped"))
        return F.when(x["s"] < acc["at"], late).otherwise(F.struct(x["e"].cast("int").alias("at"), made.alias("seq"), acc["skipped"].alias("skipped")))

    return F.aggregate(edits, start, put, lambda acc: F.struct(F.concat(acc["seq"], F.substr(seq, acc["at"] - s + 1)).alias("seq"), acc["skipped"].alias("skipped")))


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def shared_front(a: Column, b: Column) -> Column:
    """Length of the longest common prefix, by halving steps: 31 comparisons whatever the length."""
    room = F.least(F.length(a), F.length(b))
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(31))])
    return F.aggregate(steps, F.lit(0), lambda n, k: F.when((k <= room - n) & (F.left(a, n + k) == F.left(b, n + k)), n + k).otherwise(n))


def trimmed_front(pos: Column, ref: Column, alt: Column) -> Column:
    """struct (pos, ref, alt) without equal first bases, of which alleles of different lengths keep
    the last one, then without equal last bases; one base stays."""

    def front(v: Column) -> Column:
        r, a, n = v["ref"], v["alt"], F.length(v["ref"])
        cut = shared_front(r, a)
        cut = F.when(n == F.length(a), F.least(cut, n - 1)).otherwise(cut - 1)
        return bound(F.greatest(cut, F.lit(0)), lambda c: F.struct(c.alias("cut"), F.substr(r, c + 1).alias("ref"), F.substr(a, c + 1).alias("alt")))

    def back(v: Column) -> Column:
        r, a = v["ref"], v["alt"]
        ends = F.struct(F.reverse(r).alias("ref"), F.reverse(a).alias("alt"))
        cut = bound(ends, lambda x: F.greatest(F.least(shared_front(x["ref"], x["alt"]), F.length(r) - 1, F.length(a) - 1), F.lit(0)))
        return bound(cut, lambda c: F.struct((pos + v["cut"]).alias("pos"), F.left(r, F.length(r) - c).alias("ref"), F.left(a, F.length(a) - c).alias("alt")))

    return bound(bound(F.struct(ref.alias("ref"), alt.alias("alt")), front), back)


def group_haplotypes(variants: DataFrame, reference: DataFrame) -> DataFrame:
    """Groups of variants whose places touch, and in each the haplotype of every sample.

    variants: id, sample, contig, s, e, alt: [s, e), from 1, becomes alt; e = s inserts before s.
    reference: contig, start (from 0), seq; bases it lacks are N. Rows, one a group and sample: contig,
    group (its number within the contig), s, e, sample, ref, alt (both over the group's whole span),
    allele (equal haplotypes of a group share a number, from 0, in the order of their first sample), n
    (samples of the allele), skipped (variants of the sample that overlap an earlier one of it), and
    pos, short_ref, short_alt, the haplotype with its ends trimmed. A null in s, e, alt or sample leaves
    a variant out; equal variants of a sample count once. Of variants of one sample at one place
    insertions come first, then the shorter, then the lesser alt.

    A group meets as one row a sample with its distinct variants and as its span of the reference; no
    task holds a group's samples together."""
    rows = kept(variants.dropna(subset=["contig", "s", "e", "alt", "sample"]).select("sample", "contig", "s", "e", "alt").distinct())
    rows = kept(islands(rows).withColumnRenamed("island", "group"))
    key = ["contig", "group"]
    spans = rows.groupBy(*key).agg(F.min("s").alias("s"), F.max("e").alias("e")).withColumn("hull", F.struct(*key))
    seqs = hull_bases(spans, reference, F.array().cast("array<struct<pos: int, ref: string>>")).drop("hull").withColumnRenamed("seq", "ref")
    edits = rows.groupBy(*key, "sample").agg(F.sort_array(F.collect_list(F.struct("s", "e", "alt"))).alias("edits"))
    made = edits.join(seqs, key).withColumn("made", stitched(F.col("edits"), F.col("s"), F.col("ref")))
    made = made.select(*key, "s", "e", "sample", "ref", F.col("made.seq").alias("alt"), F.col("made.skipped").alias("skipped"))
    made = kept(made)
    alleles = made.groupBy(*key, "alt").agg(F.min("sample").alias("first"), F.count("*").alias("n"))
    alleles = alleles.select(*key, "alt", "n", (F.row_number().over(Window.partitionBy(*key).orderBy("first")) - 1).alias("allele"))
    short = trimmed_front(F.col("s"), F.col("ref"), F.col("alt"))
    df = made.join(alleles, [*key, "alt"]).withColumn("short", short)
    return df.select(*key, "s", "e", "sample", "ref", "alt", "allele", "n", "skipped", F.col("short.pos").alias("pos"), F.col("short.ref").alias("short_ref"), F.col("short.alt").alias("short_alt"))
