"""Line dedup: lines that spread over many sites are boilerplate; their first occurrence stays.

A line's spread is the number of distinct sites (``source``) that show it. HyperLogLog sketches per
line hash, merged by aggregation, estimate it in bounded memory; lines whose estimate is within
``margin`` of the threshold get an exact distinct count; lines at or above ``min_sites`` lose all
occurrences but the first by (doc_id, line number), so a passage is never lost altogether.

Defined results: lines are compared without the spaces around them, blank lines are never counted
or removed; a null text stays null; a null source is one site; rows equal in doc_id and text are
treated alike; a very long text is cut in time that grows with its lines, however many of them go;
an empty table gives an empty table. Extra columns, of any name, stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, hot_keys, salted, stored

MIN_SITES, MARGIN, LG_K = 5, 0.3, 9
KEY = ["h1", "h2"]


def line_keys(line: Column) -> list[Column]:
    """128 bits, so that no two lines of a large corpus meet."""
    return [F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("line"), line).alias("h2")]


def text_lines(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), site, pos, h1, h2: a row for each line that is not blank."""
    df = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    df = df.withColumn("line", F.trim("line")).where("line <> ''")
    return df.select("doc_id", "th", "site", "pos", *line_keys(F.col("line")))


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, margin: float = MARGIN, lg_k: int = LG_K) -> DataFrame:
    """h1, h2, n, first (doc_id, th, pos): the lines found at min_sites sites or more, n times. Stored."""
    seen = lines.groupBy(*KEY).agg(F.hll_sketch_agg("site", lg_k).alias("sketch"), F.count("*").alias("n"), F.min(F.struct("doc_id", "th", "pos")).alias("first"))
    low, high = min_sites * (1 - margin), min_sites * (1 + margin)
    seen = seen.where(F.col("n") >= min_sites).select(*KEY, "n", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    seen = stored(seen.where(F.col("sites") >= low), "line-spread")
    near = seen.where(F.col("sites") <= high).select(*KEY, "n")
    near = salted(lines.select(*KEY, "site", "doc_id", "pos"), near.select(*KEY), KEY, ["doc_id", "pos"], hot_lines(near)).select(*KEY, "site").distinct()
    exact = near.groupBy(*KEY).agg(F.count("*").alias("exact"))
    return stored(seen.join(exact, KEY, "left").where(F.coalesce("exact", "sites") >= min_sites).select(*KEY, "n", "first"), "line-boilerplate")


def hot_lines(found: DataFrame) -> DataFrame:
    return hot_keys(found, KEY, "n", found.agg(F.sum("n")).first()[0] or 0)


def removed_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """doc_id, th, gone: the positions of the lines that each text loses; texts that lose none have no row."""
    lines = stored(text_lines(docs), "lines")
    spread = spread_lines(lines, min_sites)
    found = salted(lines, spread.drop("n"), KEY, ["doc_id", "pos"], hot_lines(spread))
    found = found.where(~F.struct("doc_id", "th", "pos").eqNullSafe(F.col("first")))
    return found.groupBy("doc_id", "th").agg(F.collect_set("pos").alias("gone"))


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """row (all columns of docs as a struct), text (without the removed lines), n_lines, n_removed."""
    gone = removed_lines(docs, min_sites).withColumnRenamed("doc_id", "id")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("text").alias("th"))
    df = rows.join(gone.hint("shuffle_hash"), rows["row.doc_id"].eqNullSafe(gone["id"]) & (rows["th"] == gone["th"]), "left").select("row", "gone", F.split("row.text", "\n", -1).alias("lines"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("gone"))
    left = F.array_join(F.transform(stay, lambda i: F.get("lines", i)), "\n")
    return df.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(left).alias("text"),
        F.size(F.filter(F.coalesce("lines", F.array().cast("array<string>")), lambda x: F.trim(x) != "")).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def line_dedup(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """docs with the removed lines taken out of text (and n_chars, where there is one, brought in
    line); rows that lost lines and have no word left go. The same columns."""
    df = dedup_lines(docs, min_sites).where((F.col("n_removed") == 0) | F.col("text").rlike(WORD))
    new = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") == 0, F.col("row.n_chars")).otherwise(F.length("text")) if "n_chars" in docs.columns else None}
    kinds = dict(docs.dtypes)
    return df.select(*[(new[c].cast(kinds[c]) if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
