"""Packing tokenised documents into fixed windows: shortest-pack-first over the length histogram.

``tokenized`` writes every document's ids. Documents are cut into windows and one rest; the lengths'
histogram (at most ``window`` numbers) is packed on the driver: longest lengths first, each into the
emptiest packs that hold it, as patterns with counts. The emptiest packs are then dissolved and
their documents cut to fill the gaps of the others, so that less than one window of padding is left
in all. Documents find their place by their rank among the documents of their length.

Defined results: a null text is empty, a document has at least its end id; repeated rows are packed
each by itself; a very long text is tokenised whole and cut into windows; equal lengths are ranked by
(rid, start); an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe_tokens import tokenizer_of
from .common import stored, text_or_empty, tokenizer_path

WINDOW, END_ID, RANKED = 4096, 2, 1 << 16  # RANKED: items of a length that one task ranks, about
BIG = 1 << 48
CUTS = "rid long, start long, length long, sequence_id long, offset long"


def tokenized(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """rid, doc_id, ids (binary, 4 bytes an id, with the end id), n. Stored."""
    path = path or tokenizer_path("word_bpe_49k.json")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = end_id.to_bytes(4, "little")
        tok = tokenizer_of(path)
        for whole in batches:
            for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                ids = [x + end for x in tok.ids(b.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], ["rid", "doc_id", "ids", "n"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", text_or_empty("text").alias("text"))
    return stored(rows.mapInArrow(encode, f"rid long, doc_id {kind}, ids binary, n long"), "pack-ids")


def pack_histogram(counts: dict[int, int], window: int = WINDOW) -> list[tuple[list[int], int]]:
    """Patterns (lengths in order) and how often each is used.

    A step either uses a pattern up, which leaves the number of patterns as it is, or a length,
    which adds two at most; so there are at most 2 * window patterns, whatever the corpus."""
    heap: list[tuple[int, int, list[int], int]] = []  # emptiest first: (-space, serial, pattern, count)
    serial = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if heap and -heap[0][0] >= length:
                space, _, pattern, count = heapq.heappop(heap)
                if count > left:
                    heapq.heappush(heap, (space, serial, pattern, count - left))
                    serial += 1
                used = min(count, left)
                heapq.heappush(heap, (space + length, serial, [*pattern, length], used))
            else:
                used = left
                heapq.heappush(heap, (length - window, serial, [length], used))
            serial, left = serial + 1, left - used
    return [(pattern, count) for _, _, pattern, count in heap]


class Plan:
    """Where the rank-th document of a length goes; arrays bounded by the window, not by the corpus."""

    def __init__(self, patterns: list[tuple[list[int], int]], window: int = WINDOW):
        patterns = sorted(patterns, key=lambda p: (sum(p[0]), p[0]))
        used = np.array([sum(p) for p, _ in patterns], np.int64)
        count = np.array([c for _, c in patterns], np.int64)
        gap, melted = window - used, np.zeros(len(patterns), np.int64)  # melted: dissolved copies
        room, stream = int((gap * count).sum()), 0
        for i in range(len(patterns)):
            melted[i] = min(int(count[i]), max(0, (room - stream) // window))
            stream, room = stream + int(melted[i] * used[i]), room - int(melted[i] * gap[i])
            if melted[i] < count[i]:
                break
        kept = count - melted
        first = lambda x: np.concatenate([[0], np.cumsum(x)[:-1]]).astype(np.int64) if len(x) else x
        self.used, self.melted = used, melted
        self.sequence, self.stream = first(kept), first(melted * used)
        filled = np.flatnonzero((kept > 0) & (gap > 0))
        self.cell_pattern, self.cell_gap = filled, gap[filled]
        self.cell_at, self.cell_no = first(kept[filled] * gap[filled]), first(kept[filled])
        slots = []
        for i, (pattern, n) in enumerate(patterns):
            at = 0
            for length in pattern:
                slots.append((length, i, at, n))
                at += length
        slots.sort(key=lambda s: s[0])
        key, seen = [], {}
        for length, _, _, n in slots:
            key.append(length * BIG + seen.get(length, 0))
            seen[length] = seen.get(length, 0) + n
        self.key = np.array(key, np.int64)
        self.slot_pattern = np.array([s[1] for s in slots], np.int64)
        self.slot_at = np.array([s[2] for s in slots], np.int64)

    def place(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, ...]:
        """index (of the item), skip (ids before the cut in the item), length, sequence, offset of each cut."""
        slot = np.searchsorted(self.key, length * BIG + rank, "right") - 1
        p, copy = self.slot_pattern[slot], length * BIG + rank - self.key[slot]
        free = copy < self.melted[p]  # of a dissolved pack
        whole = np.flatnonzero(~free)
        out = [(whole, np.zeros(len(whole), np.int64), length[whole], self.sequence[p[whole]] + copy[whole] - self.melted[p[whole]], self.slot_at[slot[whole]])]
        items = np.flatnonzero(free)
        if len(items):
            lo = self.stream[p[items]] + copy[items] * self.used[p[items]] + self.slot_at[slot[items]]
            hi = lo + length[items]
            cell = lambda x: self._cell(x)[0]
            n = cell(hi - 1) - cell(lo) + 1
            which = np.repeat(np.arange(len(items)), n)
            no = cell(lo)[which] + np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
            q = np.searchsorted(self.cell_no, no, "right") - 1
            begin = self.cell_at[q] + (no - self.cell_no[q]) * self.cell_gap[q]
            a, b = np.maximum(begin, lo[which]), np.minimum(begin + self.cell_gap[q], hi[which])
            pattern = self.cell_pattern[q]
            out.append((items[which], a - lo[which], b - a, self.sequence[pattern] + no - self.cell_no[q], self.used[pattern] + a - begin))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _cell(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        q = np.searchsorted(self.cell_at, x, "right") - 1
        return self.cell_no[q] + (x - self.cell_at[q]) // self.cell_gap[q], q


def cut_places(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """CUTS rows for rows of (rid, n)."""
    items = tokens.select("rid", F.explode(F.expr(f"sequence(0L, n - 1, {window}L)")).alias("start"), "n")
    items = items.select("rid", "start", F.least(F.lit(window), F.col("n") - F.col("start")).alias("length"))
    histogram = {r["length"]: r["n"] for r in items.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most window rows
    plan = Plan(pack_histogram(histogram, window), window)
    # ranks by salt within a length, with salts in proportion to its items: a length that a third of the
    # corpus shares is numbered by as many tasks as that takes
    salts = tokens.sparkSession.createDataFrame([(k, -(-n // RANKED)) for k, n in histogram.items()], "length long, salts long")  # at most window rows
    items = items.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("rid", "start"), "salts")).drop("salts")
    counts = stored(items.groupBy("length", "salt").agg(F.count("*").alias("n")), "pack-counts")
    before = counts.selectExpr("length", "salt", "coalesce(sum(n) over (partition by length order by salt rows between unbounded preceding and 1 preceding), 0) as base")
    ranked = items.selectExpr("*", "row_number() over (partition by length, salt order by rid, start) - 1 as rank").join(before, ["length", "salt"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rid, start, length, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("rid", "start", "length", "rank"))
            i, skip, size, sequence, offset = plan.place(length, rank)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (rid[i], start[i] + skip, size, sequence, offset)], ["rid", "start", "length", "sequence_id", "offset"])

    return ranked.selectExpr("rid", "start", "length", "cast(base + rank as long) as rank").mapInArrow(place, CUTS)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW) -> DataFrame:
    """doc_id, start, length, ids (binary), doc_tokens, sequence_id, offset: one row a piece."""
    tokens = tokenized(docs, path)
    cuts = cut_places(tokens.select("rid", "n"), window).groupBy("rid").agg(F.collect_list(F.struct("start", "length", "sequence_id", "offset")).alias("cuts"))
    df = tokens.join(cuts.hint("shuffle_hash"), "rid")
    piece = lambda c: F.struct(c["start"].alias("start"), c["length"].alias("length"), F.substring("ids", (c["start"] * 4 + 1).cast("int"), (c["length"] * 4).cast("int")).alias("ids"), c["sequence_id"].alias("sequence_id"), c["offset"].alias("offset"))
    df = df.select("doc_id", F.col("n").alias("doc_tokens"), F.explode(F.transform("cuts", piece)).alias("p"))
    return df.select("doc_id", "p.start", "p.length", "p.ids", "doc_tokens", "p.sequence_id", "p.offset")
