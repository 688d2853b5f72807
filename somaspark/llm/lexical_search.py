"""Ranked lexical search over inverted treaps.

``inverted_treaps`` cuts the documents into blocks as they are read and keeps, for each block and
term, the documents that hold the term as a treap: doc order is its search order, the impact (the
score's part that does not depend on the query) its heap order, so a node carries the largest
impact of its subtree. Of equal impacts the one of the larger hash is nearer the root, which keeps
the treaps flat.

``search`` walks the treaps of an item's terms through a block at the same time. A range of
documents holds, for each term, the topmost node inside it; the sum of these nodes' weighted
impacts bounds every score in the range. Ranges whose bound is below the k-th best score so far are
dropped, the most promising ones are split at the document of their largest part, which is scored
exactly. The first blocks give each item a score that k documents reach; the others start with it.

Items meet blocks in chunks of ``CHUNK`` items: a task holds one block's treaps for a chunk's terms.

Defined results: a null or empty text and one without a term count in no statistics and are never
found; an item without a known term has no row; rows that repeat an item_id are one item; rows that
repeat a doc_id are documents of their own, and one of a null doc_id or item_id is left out; a very
long text is counted in blocks; equal scores go by doc_id; empty tables give an empty table; extra
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import stored
from .term_words import word_blocks

TOP = 50
BLOCK_DOCS, BLOCK_WORDS = 4096, 1 << 20
CHUNK, FIRST, STEP = 256, 16, 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_TERM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def terms_of(text: Column) -> Column:
    """The distinct terms of a text."""
    return F.array_distinct(F.filter(F.split(F.translate(text, UPPER, LOWER), NO_TERM), lambda x: x != ""))


def corpus_size(docs: DataFrame) -> tuple[int, int]:
    """N and L: the documents with a term and all their terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [sum(map(len, word_blocks(t.as_py()))) for t in b.column(0)]
            yield pa.RecordBatch.from_pydict({"n": [sum(map(bool, n))], "l": [sum(n)]})

    n, total = docs.where("doc_id is not null").select("text").mapInArrow(run, "n long, l long").agg(F.sum("n"), F.sum("l")).first()
    return n or 0, total or 0


def postings(docs: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """part, seq (which name a block), term, docs (places within the block), ids, impacts: a row a block and term."""

    def block(part: int, seq: int, held: list[tuple[int, np.ndarray, np.ndarray]], terms: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda x: x[0])
        norm = np.array([50 + (50 * int(tf.sum()) * n_docs) // n_terms for _, _, tf in held], np.int64)
        ids = np.array([i for i, _, _ in held], np.int64)
        d = np.repeat(np.arange(len(held), dtype=np.int32), [len(c) for _, c, _ in held])
        code, tf = np.concatenate([c for _, c, _ in held]), np.concatenate([x for _, _, x in held]).astype(np.int64)
        order = np.argsort(code, kind="stable")
        d, tf = d[order], tf[order]
        impacts = (1_000_000_000 * tf) // (1000 * tf + 20 * norm[d])
        ends, names = np.append(0, np.cumsum(np.bincount(code, minlength=len(terms)))), list(terms)
        for lo in range(0, len(names), 4096):
            cut = ends[lo : lo + 4097]
            own, lists = slice(cut[0], cut[-1]), pa.array((cut - cut[0]).astype(np.int32))
            key = [pa.array(np.full(len(cut) - 1, x, np.int32)) for x in (part, seq)]
            yield pa.RecordBatch.from_arrays([*key, pa.array(names[lo : lo + 4096], pa.binary()).cast(pa.string()), *[pa.ListArray.from_arrays(lists, pa.array(x)) for x in (d[own], ids[d[own]], impacts[own])]], ["part", "seq", "term", "docs", "ids", "impacts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held, terms, size = TaskContext.get().partitionId(), 0, [], {}, 0
        for b in batches:
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                counts: Counter = Counter()
                for words in word_blocks(text.as_py()):
                    counts.update(words)
                if counts:
                    held.append((i, np.fromiter((terms.setdefault(t, len(terms)) for t in counts), np.int32, len(counts)), np.fromiter(counts.values(), np.int32, len(counts))))
                    size += len(counts)
                if len(held) >= BLOCK_DOCS or size >= BLOCK_WORDS:
                    yield from block(part, seq, held, terms)
                    held, terms, size, seq = [], {}, 0, seq + 1
        if held:
            yield from block(part, seq, held, terms)

    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "part int, seq int, term string, docs array<int>, ids array<long>, impacts array<long>")


def treap(keys: list[int]) -> tuple[list[int], list[int], int]:
    """Left and right child of each place and the root: heap order by keys, which are distinct."""
    left, right, path = [-1] * len(keys), [-1] * len(keys), []
    for i, k in enumerate(keys):
        last = -1
        while path and keys[path[-1]] < k:
            last = path.pop()
        left[i] = last
        if path:
            right[path[-1]] = i
        path.append(i)
    return left, right, path[0]


def inverted_treaps(docs: DataFrame, terms: DataFrame, n_docs: int, n_terms: int) -> DataFrame:
    """The postings of the given terms (term, distinct) with left and right children and the root. Stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (w.slice(i, 256) for w in batches for i in range(0, w.num_rows, 256)):
            left, right, roots = [], [], []
            for d, impacts in zip(b.column("docs"), b.column("impacts"), strict=True):
                # an odd factor: distinct for distinct places
                spread = ((d.values.to_numpy().astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
                links = treap(((impacts.values.to_numpy() << 32) | spread.astype(np.int64)).tolist())
                for kept, x in ((left, links[0]), (right, links[1])):
                    kept.append(np.array(x, np.int32))
                roots.append(links[2])
            ends = pa.array(np.append(0, np.cumsum([len(x) for x in left])).astype(np.int32))
            more = [*(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in (left, right)), pa.array(roots, pa.int32())]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*b.schema.names, "left", "right", "root"])

    rows = postings(docs, n_docs, n_terms).join(terms, "term", "left_semi").select("part", "seq", "term", "docs", "ids", "impacts")
    return stored(rows.mapInArrow(run, "part int, seq int, term string, docs array<int>, ids array<long>, impacts array<long>, left array<int>, right array<int>, root int"), "treaps")


class Treaps:
    """One block's treaps, laid end to end; place -1 holds an empty node."""

    def __init__(self, rows: pa.Table):
        flat = lambda c: rows.column(c).combine_chunks().flatten().to_numpy()
        n = np.diff(rows.column("docs").combine_chunks().offsets.to_numpy())
        base = np.cumsum(n) - n
        shift = np.repeat(base, n)
        self.number = {t: i for i, t in enumerate(rows.column("term").to_pylist())}
        self.docs, self.ids = np.append(flat("docs").astype(np.int64), 0), flat("ids")
        self.impacts = np.append(flat("impacts"), 0)
        self.left, self.right = (np.append(np.where(x < 0, -1, x + shift), -1) for x in (flat("left"), flat("right")))
        self.roots = base + rows.column("root").to_numpy()
        self.width = int(self.docs.max()) + 1
        # a document's place in a term's treap is found by these ascending codes
        self.codes = np.append(np.repeat(np.arange(len(n)), n) * self.width + self.docs[:-1], -1)

    def inside(self, node: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The topmost nodes strictly between lo and hi in the subtrees of node."""
        node = node.copy()
        while True:
            d = self.docs[node]
            high, low = (node >= 0) & (d >= hi), (node >= 0) & (d <= lo)
            if not (high.any() or low.any()):
                return node
            node = np.where(high, self.left[node], np.where(low, self.right[node], node))

    def best(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the block's k best documents, at least of the score ``least``; ties by id."""
        lo, hi, node = np.array([-1]), np.array([self.width]), self.roots[terms][None, :]
        bound = (weights * self.impacts[node]).sum(1)
        ids, scores, step = np.zeros(0, np.int64), np.zeros(0, np.int64), STEP
        while True:
            live = bound >= least  # an equal score may win by its id
            lo, hi, node, bound = lo[live], hi[live], node[live], bound[live]
            if not len(bound):
                order = np.lexsort((ids, -scores))[:k]
                return ids[order], scores[order]
            order = np.argsort(-bound)
            now, rest = order[:step], order[step:]
            parts = weights * self.impacts[node[now]]
            top = node[now, parts.argmax(1)]
            d = self.docs[top]
            want = terms * self.width + d[:, None]
            at = np.searchsorted(self.codes[:-1], want)
            exact = (weights * np.where(self.codes[at] == want, self.impacts[at], 0)).sum(1)
            good = exact >= least
            ids, scores = np.append(ids, self.ids[top[good]]), np.append(scores, exact[good])
            if len(scores) >= k:
                least = max(least, int(np.partition(scores, -k)[-k]))
                good = scores >= least
                ids, scores = ids[good], scores[good]
            new_lo, new_hi = np.concatenate([lo[now], d]), np.concatenate([d, hi[now]])
            new = self.inside(np.concatenate([node[now], node[now]]), new_lo[:, None], new_hi[:, None])
            lo, hi, node = np.concatenate([lo[rest], new_lo]), np.concatenate([hi[rest], new_hi]), np.concatenate([node[rest], new])
            bound = np.concatenate([bound[rest], (weights * self.impacts[new]).sum(1)])
            step = min(2 * step, 1024)


def _met(index: DataFrame, items: DataFrame, blocks: Column, k: int) -> DataFrame:
    """item_id, doc_id, score: each block's k best documents of each item. index: block, chunk, ...; blocks:
    those that the items go to. Stored."""
    kind = dict(items.dtypes)["item_id"]

    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("item_id", right.schema.field("item_id").type), ("doc_id", pa.int64()), ("score", pa.int64())])
        out = []
        if left.num_rows:
            treaps = Treaps(left)
            for item, least, terms in zip(right.column("item_id"), right.column("least").to_pylist(), right.column("terms").to_pylist(), strict=True):
                known = [(treaps.number[t["term"]], t["weight"]) for t in terms if t["term"] in treaps.number]
                if known:
                    t, w = (np.array(x, np.int64) for x in zip(*known, strict=True))
                    ids, scores = treaps.best(t, w, k, max(1, least))
                    out.append(pa.Table.from_arrays([pa.array([item.as_py()] * len(ids), schema.types[0]), pa.array(ids), pa.array(scores)], schema=schema))
        return pa.concat_tables(out) if out else schema.empty_table()

    spread = items.select(F.col("chunk").alias("to_chunk"), "item_id", "terms", "least", F.explode(blocks).alias("to_block"))
    pairs = index.groupBy("block", "chunk").cogroup(spread.groupBy("to_block", "to_chunk"))
    return stored(pairs.applyInArrow(run, f"item_id {kind}, doc_id long, score long"), "found")


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each row of items (item_id, text)."""
    asked = items.where("item_id is not null").select("item_id", F.explode(terms_of(F.col("text"))).alias("term")).distinct()
    n_docs, n_terms = corpus_size(docs)
    index = inverted_treaps(docs, asked.select("term").distinct(), n_docs, n_terms)
    df = index.groupBy("term").agg(F.sum(F.size("docs")).alias("df"))
    weighted = asked.join(df, "term").select("item_id", "term", F.floor(1000 * F.log((2 * F.lit(n_docs) + 2) / (2 * F.col("df") + 1))).cast("long").alias("weight")).where("weight > 0")
    chunks = -(-max(1, items.count()) // CHUNK)
    wanted = weighted.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("terms"))
    wanted = stored(wanted.withColumn("chunk", F.pmod(F.xxhash64("item_id"), F.lit(chunks)).cast("int")), "items")

    parts, seqs = (x or 0 for x in index.agg(F.max("part") + 1, F.max("seq") + 1).first())
    blocks = parts * seqs
    index = index.withColumn("block", F.col("part").cast("long") * seqs + F.col("seq")).drop("part", "seq")
    index = index.join(wanted.select("chunk", F.explode("terms.term").alias("term")).distinct(), "term")
    some = lambda way: F.filter(F.sequence(F.lit(0).cast("long"), F.lit(max(blocks - 1, 0)).cast("long")), way)
    early, first = F.col("block") % FIRST == 0, wanted.withColumn("least", F.lit(0).cast("long"))
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    best = lambda found: found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    found = best(_met(index.where(early), first, some(lambda b: b % FIRST == 0), k)).drop("rank")
    if blocks > 1:
        known = found.groupBy("item_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") == k).drop("n")
        later = wanted.join(known, "item_id", "left").withColumn("least", F.coalesce("least", F.lit(0).cast("long")))
        found = found.union(_met(index.where(~early), later, some(lambda b: b % FIRST != 0), k))
    return best(found).select("item_id", F.col("rank").cast("int"), "doc_id", "score")
