"""Near-duplicate detection: SetSketch registers, banded, estimated jointly, verified on full sets.

1. ``sketched``: the shingle set's size, a 128-bit key of the set and the registers of every text.
   Texts of equal sets form a class at once; one document of each class goes on.
2. Bands of registers bring candidates together. Every member of a bucket meets the bucket's first
   member; pairs whose likelihood estimate (five standard errors of slack) or sizes rule the
   threshold out are dropped; the others are verified on their full sets. A member's likeliest
   pair comes first, its other pairs only if they still join two components.
3. Members of a bucket that are not of one component by then meet each other as well, so that no
   link between texts of one bucket is lost. Two texts can only be linked if they share a shingle
   that few of these members have, which names the pair, or have enough shingles that many have;
   the latter bound rules out nearly all pairs of a group of loose copies, so that thousands of
   copies cost a few pairs a member and not their square.

With 32 bands of 5 registers a pair at the threshold of 0.8 misses all buckets with a probability
of 3e-6, a likelier pair with less.

Defined results: a null or empty text and one of white space alone has an empty set and is linked
with nothing; texts of fewer words than a shingle have one shingle; rows that repeat a doc_id are one
document (its least text is compared); a null doc_id is never linked; a very long text is hashed in blocks and its
whole set is compared; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, salted, stored
from .components import labels_of, more_labels
from .setsketch import REGISTERS, WORDS_A_SHINGLE, likely_jaccard, mix, registers, shingles

BANDS, ROWS = 32, 5
PERCENT, SLACK, RARE = 80, 0.16, 40
BATCH_SHINGLES = 1 << 16


def _sets(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """doc_ids and sets, in groups of about BATCH_SHINGLES shingles."""
    for b in batches:
        sets, held, first = [], 0, 0
        for i, text in enumerate(b.column("text")):
            sets.append(shingles(text.as_py(), words))
            held += len(sets[-1])
            if held >= BATCH_SHINGLES:
                yield b.column("doc_id").slice(first, len(sets)), sets
                sets, held, first = [], 0, i + 1
        if sets:
            yield b.column("doc_id").slice(first, len(sets)), sets


def sketched(docs: DataFrame, words: int = WORDS_A_SHINGLE) -> DataFrame:
    """doc_id, n (set size), k1, k2 (key of the set), regs (binary; null for an empty set). Stored."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, sets in _sets(batches, words):
            n = np.array([len(s) for s in sets], np.int64)
            full = np.flatnonzero(n)
            k1, k2, regs = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64), [None] * len(n)
            if len(full):
                values = np.concatenate([sets[i] for i in full])
                starts = np.cumsum(n[full]) - n[full]
                k1[full], k2[full] = np.add.reduceat(mix(values), starts), np.add.reduceat(mix(~values), starts)
                for i, r in zip(full, registers(values, starts), strict=True):
                    regs[i] = r.tobytes()
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(regs, pa.binary())], ["doc_id", "n", "k1", "k2", "regs"])

    return stored(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n long, k1 long, k2 long, regs binary"), "sketches")


def full_sets(docs: DataFrame, ids: DataFrame, words: int = WORDS_A_SHINGLE) -> DataFrame:
    """id, items (array of shingle hashes) of the documents in ids. Stored."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got, sets in _sets(batches, words):
            values = np.concatenate(sets).view(np.int64)
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([got, pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["id", "items"])

    # one text an id, as dealt by the join: repeated rows go before the larger sets are made
    wanted = docs.select("doc_id", "text").join(ids.select(F.col("id").alias("doc_id")).hint("shuffle_hash"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
    return stored(wanted.mapInArrow(run, f"id {kind}, items array<long>"), "sets", "lz4")


def alike(percent: int = PERCENT) -> Column:
    """Whether the set sizes na and nb allow the similarity."""
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def estimated(pairs: DataFrame, reps: DataFrame, percent: int = PERCENT, slack: float = SLACK) -> DataFrame:
    """a, b, est: those of the distinct pairs (a, b, na, nb) that the likelihood leaves over. Stored."""
    kind = dict(pairs.dtypes)["a"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 4096) for i in range(0, whole.num_rows, 4096)):
                regs = [np.frombuffer(b"".join(b.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("ra", "rb")]
                est = likely_jaccard(*regs, *(b.column(c).to_numpy().astype(float) for c in ("na", "nb")))
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(est)], ["a", "b", "est"])

    side = lambda c: reps.select(F.col("doc_id").alias(c), F.col("regs").alias("r" + c))
    df = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb")
    return stored(df.mapInArrow(run, f"a {kind}, b {kind}, est double").where(F.col("est") >= percent / 100 - slack), "pairs")


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full sets meet the threshold: 100 * intersection >= percent * union."""
    side = lambda c: sets.select(F.col("id").alias(c), F.col("items").alias("s" + c))
    df = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
    both = F.size(F.array_intersect("sa", "sb"))
    df = df.select("a", "b", both.cast("long").alias("both"), (F.size("sa") + F.size("sb")).cast("long").alias("all"))
    return stored(df.where(100 * F.col("both") >= percent * (F.col("all") - F.col("both"))).select("a", "b"), "links")


def met(members: DataFrame, buckets: DataFrame, hot: DataFrame) -> DataFrame:
    """members joined with buckets (one small row a bucket). The rows of hot buckets, fewer than
    HOT_PARTS of them, are broadcast to their members, which need not be shuffled into one task."""
    large = [r["bucket"] for r in hot.select("bucket").collect()]
    if not large:
        return members.join(buckets, "bucket")
    is_large = F.col("bucket").isin(large)
    few, many = buckets.where(is_large), buckets.where(~is_large)
    return members.where(~is_large).join(many, "bucket").unionByName(members.where(is_large).join(F.broadcast(few), "bucket"))


def several(members: DataFrame) -> DataFrame:
    """The rows (bucket, b, label, ...) of buckets with more than one label. Stored."""
    groups = members.groupBy("bucket").agg(F.min("label").alias("l1"), F.max("label").alias("l2"), F.count("*").alias("size"))
    hits = stored(groups.where("l1 <> l2").select("bucket", "size"), "buckets-mixed")
    total = hits.agg(F.sum("size")).first()[0] or 0
    return stored(met(members, hits.select("bucket"), hot_keys(hits, ["bucket"], "size", total)), "bucket-mixed")


def rare_shingles(sets: DataFrame, percent: int = PERCENT, most: int = RARE) -> tuple[DataFrame, DataFrame]:
    """For each set its size n and how many of its shingles are in more than ``most`` of the sets
    (common); and the pairs a < b of sets of like sizes (na, nb) that share a rarer one. Both stored.

    A rare shingle names ``most`` sets at most, and equal lists of sets are taken once, so the pairs
    grow with the sets and not with the square of a group of copies."""
    items = sets.select("id", F.size("items").cast("long").alias("n"), F.explode("items").alias("item"))
    n = stored(items.groupBy("item").agg(F.count("*").alias("k"), F.min("id").alias("id")).where(F.col("k") <= most), "rare-items", "lz4")
    rare = stored(items.join(n.where("k > 1").select("item"), "item"), "rare-places", "lz4")
    less = n.where("k = 1").select("id").union(rare.select("id")).groupBy("id").agg(F.count("*").alias("less"))
    counts = sets.select("id", F.size("items").cast("long").alias("n")).join(less, "id", "left")
    counts = counts.selectExpr("id", "n", "n - coalesce(less, 0) as common")
    lists = rare.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("id", "n"))).alias("ids")).select("ids").distinct()
    pairs = lists.select("ids", F.posexplode("ids").alias("i", "a")).select("a", F.explode(F.slice("ids", F.col("i") + 2, F.size("ids"))).alias("b"))
    pairs = pairs.select("a.id", "b.id", "a.n", "b.n").toDF("a", "b", "na", "nb").where(alike(percent)).distinct()
    return stored(counts, "set-counts"), stored(pairs, "rare-pairs")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, words: int = WORDS_A_SHINGLE) -> DataFrame:
    """doc_id, n_shingles, component_id: a row for each row of docs; shingles of so many words."""
    sketch = sketched(docs, words)
    named = sketch.where("doc_id is not null and n > 0")
    # equal sets have equal registers: any row of a class stands for all
    first = stored(named.groupBy("k1", "k2", "n").agg(F.min("doc_id").alias("first"), F.min("regs").alias("regs"), F.count("*").alias("rows")), "classes")
    reps = first.select(F.col("first").alias("doc_id"), "n", "regs")

    width = ROWS * 2
    band = lambda i: F.xxhash64(F.lit(i), F.substring("regs", i * width + 1, width))
    members = reps.select("doc_id", "n", F.explode(F.array(*[band(i) for i in range(BANDS)])).alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.min(F.struct("doc_id", "n")).alias("a"), F.count("*").alias("size")).where("size > 1")
    buckets = stored(buckets.select("bucket", F.col("a.doc_id").alias("a"), F.col("a.n").alias("na"), "size"), "buckets")
    hot = hot_keys(buckets, ["bucket"], "size", buckets.agg(F.sum("size")).first()[0] or 0)
    shared = stored(met(members, buckets, hot).select("bucket", "a", "na", F.col("doc_id").alias("b"), F.col("n").alias("nb"), "size"), "bucket-members")
    pairs = estimated(shared.where((F.col("a") != F.col("b")) & alike(percent)).select("a", "b", "na", "nb").distinct(), reps, percent)

    ids = lambda p: p.select(F.col("a").alias("id")).union(p.select("b")).distinct()
    sets = full_sets(docs, ids(pairs), words)
    best = pairs.groupBy("b").agg(F.max_by("a", F.struct("est", F.xxhash64("a"))).alias("a")).select("a", "b")
    links = verified(best, sets, percent)
    labels = labels_of(links)

    def apart(p: DataFrame) -> DataFrame:
        of = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias("l" + c))
        df = p.join(of("a"), "a", "left").join(of("b"), "b", "left")
        return df.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select(*p.columns)

    more = stored(apart(pairs.select("a", "b").join(best, ["a", "b"], "left_anti")), "pairs-left")
    if not more.isEmpty():
        labels = more_labels(labels, verified(more, sets, percent))

    # buckets of three and more that still hold several components: their members meet each other,
    # as far as rare shingles allow
    of = labels.select(F.col("node").alias("b"), "label")
    mixed = several(shared.where("size > 2").join(of, "b", "left").select("bucket", "b", F.coalesce("label", "b").alias("label")))
    if not mixed.isEmpty():
        people = stored(mixed.select(F.col("b").alias("id")).distinct(), "mixed-ids")
        sets = full_sets(docs, people, words)
        counts, sharers = rare_shingles(sets, percent)
        able = counts.where(100 * F.col("common") >= percent * F.col("n")).select(F.col("id").alias("b"), "n", "common")
        mixed = several(mixed.join(able, "b"))
        left, right = mixed.select("bucket", F.col("b").alias("a"), F.col("label").alias("la"), F.col("n").alias("na"), F.col("common").alias("ca")), mixed.select("bucket", "b", F.col("label").alias("lb"), F.col("n").alias("nb"), F.col("common").alias("cb"))
        most = F.least("ca", "cb")  # of the intersection, if no rare shingle is shared
        # no salts here: they would copy every member of a bucket; a skewed join is split when it runs
        rest = left.join(right, (left["bucket"] == right["bucket"]) & (F.col("a") < F.col("b")) & (F.col("la") != F.col("lb")) & (100 * most >= percent * (F.col("na") + F.col("nb") - most)))
        rest = rest.select("a", "b", "na", "nb").union(apart(sharers)).distinct()
        known = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        rest = estimated(rest.join(known, ["a", "b"], "left_anti"), reps, percent)
        if not rest.isEmpty():
            labels = more_labels(labels, verified(rest, sets, percent))

    lowest = labels.groupBy("label").agg(F.min("node").alias("component"))
    parts = labels.join(lowest, "label").select(F.col("node").alias("first"), "component")
    classes = first.join(parts, "first", "left").select("k1", "k2", "n", F.coalesce("component", "first").alias("component"))
    hot = hot_keys(first, ["k1", "k2", "n"], "rows", sketch.count())
    df = salted(sketch, stored(classes, "class-components"), ["k1", "k2", "n"], ["doc_id"], hot, "left")
    return df.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def near_dedup(docs: DataFrame, percent: int = PERCENT, words: int = WORDS_A_SHINGLE) -> DataFrame:
    """docs without the documents that another of smaller doc_id stands for; the same columns."""
    gone = near_duplicates(docs, percent, words).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone.hint("shuffle_hash"), "doc_id", "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
