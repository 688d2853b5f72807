"""Quality rules whose limits come from mergeable quantile sketches per language and source.

``measured`` counts words, symbols, repeated lines and repeated word windows of every whole text.
``limits`` keeps one KLL sketch a metric and (lang, source) over the documents that pass the base
rule and merges them to languages and to the whole corpus; groups under ``min_rows`` documents use
the next wider level. A limit lies beyond a quantile near the group's end by ``FENCE`` times that
quantile's distance from the median; ``judged`` joins the limits back. No rate or length is fixed:
the parameters are the quantiles and the fence. A metric whose high values are common among good
documents (repeated lines, words, capitals) has its quantile farther out.

Defined results: a null or empty text has no words and fails the base rule; null lang or source is a
group of its own, and so are all rows where the column is absent; ties with a limit are kept;
repeated rows are judged alike, each by itself; a very long text is counted whole; an empty table
gives an empty table; all columns of the input are kept in the struct ``row``, so no name can clash.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words")
#: Metric -> (numerator, denominator, quantile that the upper fence starts from, the lower one's or None).
METRICS = {
    "symbol_rate": ("n_symbols", "n_words", 0.9, None),
    "dup_line_rate": ("n_dup_lines", "n_lines", 0.99, None),
    "repeat_rate": ("n_repeat_words", "n_words", 0.99, None),
    "upper_rate": ("n_upper_words", "n_words", 0.99, None),
    "mean_word": ("word_chars", "n_words", 0.9, 0.1),
}
SKETCH_K, FENCE, MIN_ROWS = 1024, 3.0, 50


def text_counts(text: str | None) -> tuple[int, ...]:
    """COUNTS of one text."""
    if not text:
        return (0,) * len(COUNTS)
    words = WORDS.findall(text)
    n = len(words)
    seen: set[str] = set()
    lines = dup = 0
    for line in text.split("\n"):
        if WORDS.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    repeat = 0
    grams = list(zip(words, words[1:], words[2:], strict=False))
    if len(grams) != len(set(grams)):
        found, covered = Counter(grams), 0  # covered: words before this position are counted already
        for i, g in enumerate(grams):
            if found[g] > 1:
                repeat += i + 3 - max(covered, i)
                covered = i + 3
    return n, sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeat, lines, sum(map(str.isupper, words))


def _counts(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([text_counts(t) for t in texts], columns=COUNTS, dtype="int64")


def measured(docs: DataFrame) -> DataFrame:
    """row (all columns of docs), the COUNTS, lang_key and source_key."""
    counts = F.pandas_udf(_counts, ", ".join(f"{c} long" for c in COUNTS))
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) if c in docs.columns else F.lit("-")
    df = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), counts(F.col("text")).alias("m"), key("lang").alias("lang_key"), key("source").alias("source_key"))
    return df.select("row", "m.*", "lang_key", "source_key")


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def limits(m: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """lang_key, source_key, n and a sketch a metric; the wider levels have null keys."""
    rates = {c: F.col(a).cast("double") / F.col(b) for c, (a, b, _, _) in METRICS.items()}
    groups = stored(m.where(~base_failed()).groupBy("lang_key", "source_key").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(x, k).alias(c) for c, x in rates.items()]), "quality-sketches")
    merged = lambda g: g.agg(F.sum("n").alias("n"), *[F.kll_merge_agg_double(c, k).alias(c) for c in METRICS])
    wide = merged(groups.groupBy("lang_key")).withColumn("source_key", F.lit(None).cast("string"))
    whole = merged(groups.groupBy()).where("n > 0").withColumns({"lang_key": F.lit(None).cast("string"), "source_key": F.lit(None).cast("string")})
    return groups.unionByName(wide).unionByName(whole)


def fences(lim: DataFrame, fence: float = FENCE) -> DataFrame:
    at = lambda c, q: F.kll_sketch_get_quantile_double(c, F.lit(q))
    out = []
    for c, (_, _, high, low) in METRICS.items():
        out.append((at(c, high) + fence * (at(c, high) - at(c, 0.5))).alias(f"{c}_high"))
        if low is not None:
            out.append((at(c, low) - fence * (at(c, 0.5) - at(c, low))).alias(f"{c}_low"))
    return lim.select("lang_key", "source_key", "n", *out)


def judged(m: DataFrame, min_rows: int = MIN_ROWS, fence: float = FENCE, k: int = SKETCH_K) -> DataFrame:
    """m with base_failed and kept."""
    lim = stored(fences(limits(m, k), fence), "quality-limits")
    bounds = [c for c in lim.columns if c.endswith(("_low", "_high"))]
    pack = F.struct("n", *bounds)
    group = lim.where("source_key is not null").select("lang_key", "source_key", pack.alias("g"))
    wide = lim.where("lang_key is not null and source_key is null").select("lang_key", pack.alias("l"))
    whole = lim.where("lang_key is null").select(pack.alias("w"))
    # one row a group: the narrowest level with rows enough; the one-row level is joined by a constant key
    chosen = group.join(wide, "lang_key").join(F.broadcast(whole), F.lit(True))
    chosen = chosen.select("lang_key", "source_key", F.when(F.col("g.n") >= min_rows, F.col("g")).when(F.col("l.n") >= min_rows, F.col("l")).otherwise(F.col("w")).alias("lim"))
    df = m.join(chosen, ["lang_key", "source_key"], "left")
    good = F.lit(True)
    for c, (a, b, _, low) in METRICS.items():
        rate = F.col(a).cast("double") / F.when(F.col(b) > 0, F.col(b))
        good = good & (rate <= F.col(f"lim.{c}_high"))
        if low is not None:
            good = good & (rate >= F.col(f"lim.{c}_low"))
    return df.select(*m.columns, base_failed().alias("base_failed"), (~base_failed() & F.coalesce(good, F.lit(False))).alias("kept"))


def quality_filter(docs: DataFrame, **how) -> DataFrame:
    """docs without the rows that the rules reject; the same columns."""
    m = stored(measured(docs), "quality-rows")
    return judged(m, **how).where("kept").select("row.*")
