"""Phrase collocation mining by suffixes (suffix-sigma).

``suffixes`` turns every word of every piece into its suffix of at most ``MOST`` words, equal ones of
a task counted together (``Held``, up to ``KEPT`` distinct ones at a time). They are dealt by language
and first word; ``tails`` sends a task's suffixes of one first word as one row, a list of what follows
it: its rows are bounded by the first words that a task meets. Each task sorts its rows by first word, and ``prefix_counts`` sums the prefixes of whole first words, about ``HELD`` suffixes at a
time; a first word with more is counted in parts, whose sums are added up afterwards.

A phrase is frequent only if its parts are. The first pass over the texts therefore counts words,
pairs and triples by hash in three tables of fixed size (``BITS``); sums of a place bound the counts
of all that fall there. A suffix is cut before the first word, pair or triple whose place stays under
the least count: no frequent phrase is lost, whatever falls together, and the cut suffixes fold well.

A first word with more than a ``HOT_PARTS``-th of all words is dealt by its second word too, a hot
pair by its third word, and so on, each over ``2**DEAL_BITS`` parts of the first word; the counts of such hot prefixes are sums over tasks. ``survey``
finds them; which prefixes are hot changes where rows go, not what is counted.

``collocations`` cuts each candidate in two at every place, joins the parts' counts, scores the
candidate by its lowest cut and drops candidates that a longer one explains.

Defined results: a null text has no word; a null lang is ``und``; a piece of one word counts for n
and for parts alone; repeated rows count each time; a very long text is cut into blocks at spaces,
and its suffixes run on over the cuts; ties go by the phrase; an empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from .common import HOT_PARTS, hot_keys, salted, stored

MOST, MIN_COUNT, PERCENT, TOP = 4, 30, 80, 2000
WORDS = ["w1", "w2", "w3", "w4"]
BLOCK_WORDS, SLICE, HELD, KEPT = 1 << 18, 1 << 22, 1 << 19, 1 << 20
BITS, CHUNK, FAN, DEAL_BITS = 24, 1 << 16, 64, 7
ODD = np.uint64(0x9E3779B97F4A7C15)
#: A-Z lower-cased, the pieces' ends to a full stop, tabs to spaces.
TABLE = bytes(46 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens(text: str | None) -> Iterator[list[bytes]]:
    """The words of a text and a full stop for each end of a piece, in lists of about SLICE bytes."""
    data, at = (text or "").encode("utf-8", "surrogatepass").translate(TABLE), 0
    while at < len(data):
        end = data.find(b" ", at + SLICE)
        end = len(data) if end < 0 else end
        yield data[at:end].replace(b".", b" . ").split()
        at = end
    yield [b"."]


class Block:
    """Words coded in order, with their languages; what follows a word in its piece stays together."""

    def __init__(self, langs: list[str], counts: list[int], words: list[bytes]):
        coded = pa.array(words, pa.binary()).dictionary_encode()
        names = coded.dictionary
        order = np.asarray(pc.sort_indices(names, sort_keys=[("", "descending")]))
        rank = np.empty(len(names) + 1, np.int64)
        rank[order] = np.arange(1, len(names) + 1)
        code = rank[coded.indices.to_numpy()]
        stop = names.index(b".").as_py()
        code[code == (rank[stop] if stop >= 0 else -1)] = 0  # 0: no word
        self.names = pa.concat_arrays([pa.array([None], pa.binary()), names.take(pa.array(order))]).cast(pa.string())
        self.langs = pa.array(langs, pa.string()).dictionary_encode()
        self.lang = np.repeat(self.langs.indices.to_numpy().astype(np.int64), counts)
        after = [np.append(code[i:], np.zeros(i, np.int64)) for i in range(MOST)]
        for i in range(1, MOST):  # nothing follows the end of a piece
            after[i] = np.where(after[i - 1] == 0, 0, after[i])
        self.after = after
        hashes = lambda names: np.fromiter((hash_of(x) for x in names.to_pylist()), np.uint64, len(names))
        self.hashes, self.lang_hashes = hashes(self.names), hashes(self.langs.dictionary)

    def places(self, k: int, bits: int = BITS) -> np.ndarray:
        """For each word the place of the k words from there on in a table of 2**bits."""
        h = self.lang_hashes[self.lang]
        for words in self.after[:k]:
            h = (h ^ self.hashes[words]) * ODD
            h ^= h >> np.uint64(29)
        return ((h * ODD) >> np.uint64(64 - bits)).astype(np.int64)

    def cut(self, often: list[np.ndarray]) -> None:
        """Cut the suffixes before what cannot be frequent. often: the places of words, pairs and triples that can."""
        word, pair, triple = (x[self.places(k)] for k, x in enumerate(often, 1))
        a, next_triple = self.after, np.append(triple[1:], True)
        pair = pair & word
        a[0] = np.where(word, a[0], 0)
        a[1] = np.where(pair, a[1], 0)
        a[2] = np.where((a[1] > 0) & triple, a[2], 0)
        a[3] = np.where((a[2] > 0) & next_triple, a[3], 0)

    def suffixes(self, end: int) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
        """Languages, words and counts of the distinct suffixes that begin before end, in order."""
        at = np.flatnonzero(self.after[0][:end])
        a, v = [x[at] for x in self.after], len(self.names)
        high, low = (self.lang[at] * v + a[0]) * v + a[1], a[2] * v + a[3]
        order, starts = _runs(high, low)
        pick = order[starts]
        return self.lang[at][pick], [x[pick] for x in a], np.diff(np.append(starts, len(order)))


def _runs(high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows by both keys and where each distinct one begins in it."""
    order = np.lexsort((low, high))
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(high[order]) != 0) | (np.diff(low[order]) != 0)
    return order, np.flatnonzero(first)


class Held:
    """The distinct suffixes of several blocks, coded alike, with their counts."""

    def __init__(self):
        self.names, self.hashes = pa.array([None], pa.string()), np.array([hash_of(None)], np.uint64)
        self.langs: dict[str, int] = {}
        self.codes, self.n = [np.zeros((MOST + 1, 0), np.int32)], [np.zeros(0, np.int64)]
        self.size = self.found = 0  # distinct suffixes, in all

    def add(self, block: Block, end: int) -> None:
        lang, words, n = block.suffixes(end)
        used = np.zeros(len(block.names), bool)
        for x in words:
            used[x] = True
        used = np.flatnonzero(used)
        names = block.names.take(pa.array(used))
        ids = pc.index_in(names, value_set=self.names).fill_null(-1).to_numpy().copy()
        new = np.flatnonzero(ids < 0)
        ids[new] = len(self.names) + np.arange(len(new))
        self.names = pa.concat_arrays([self.names, names.take(pa.array(new))])
        self.hashes = np.append(self.hashes, block.hashes[used[new]])
        code = np.zeros(len(block.names), np.int32)
        code[used] = ids
        langs = np.array([self.langs.setdefault(x, len(self.langs)) for x in block.langs.dictionary.to_pylist()], np.int32)
        self.codes.append(np.stack([langs[lang], *(code[x] for x in words)]))
        self.n.append(n)
        self.size += len(n)
        self.found += int(n.sum())

    def fold(self) -> None:
        """Count equal suffixes together, in order."""
        codes, n, v = np.concatenate(self.codes, axis=1), np.concatenate(self.n), len(self.names)
        order, starts = _runs((codes[0].astype(np.int64) * v + codes[1]) * v + codes[2], codes[3].astype(np.int64) * v + codes[4])
        if len(starts):
            self.codes, self.n = [codes[:, order[starts]]], [np.add.reduceat(n[order], starts)]
        self.size = len(starts)


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[Block, int]]:
    """Blocks of about size words and how many of them are new; the last words of one begin the next."""
    langs, counts, words = [], [], []
    for b in batches:
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
            for some in tokens(text.as_py()):
                for i in range(0, len(some), size):
                    part = some[i : i + size]
                    langs.append(lang)
                    counts.append(len(part))
                    words += part
                    if len(words) >= size + MOST:
                        yield Block(langs, counts, words), len(words) - MOST + 1
                        keep = words[-MOST + 1 :]
                        back = np.repeat(np.arange(len(langs)), counts)[-MOST + 1 :]
                        langs, counts, words = [langs[k] for k in back], [1] * len(keep), keep
    if words:
        yield Block(langs, counts, words), len(words)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")


def survey(docs: DataFrame, min_count: int = MIN_COUNT, parts: int = HOT_PARTS, size: int = BLOCK_WORDS) -> tuple[DataFrame, dict[str, int], list[np.ndarray]]:
    """The prefixes (lang, w1..w3) with more than a parts-th of all words, each language's words, and the
    places of words, pairs and triples that can hold one found min_count times.

    A block names the prefixes that hold half of that share of it: few, whatever the input; what
    other blocks hold of them may be missed, so a count is a lower bound."""
    cap = min(min_count, 255)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = np.zeros((MOST - 1, 1 << BITS), np.uint8)
        for block, end in _blocks(batches, size):
            for k, table in enumerate(tables, 1):
                place, n = np.unique(block.places(k)[:end][block.after[k - 1][:end] > 0], return_counts=True)
                table[place] = np.minimum(table[place] + n, cap)
            lang, words = block.lang[:end], [x[:end] for x in block.after[: MOST - 1]]
            live = np.flatnonzero(words[0])
            least, v, key = len(live) / (2 * parts), len(block.names), lang[live]
            yield _prefixes(block, *np.unique(key, return_counts=True), [])
            for depth in range(MOST - 1):
                live, key = live[words[depth][live] > 0], key[words[depth][live] > 0]
                got, back, n = np.unique(key * v + words[depth][live], return_inverse=True, return_counts=True)
                big = np.flatnonzero(n > least)
                place = np.full(len(n), -1)
                place[big] = np.arange(len(big))
                one = np.zeros(len(big), np.int64)
                stay = place[back] >= 0
                live, key = live[stay], place[back][stay]
                one[key] = live  # a position that shows the prefix
                yield _prefixes(block, lang[one], n[big], [w[one] for w in words[: depth + 1]])
        slot = TaskContext.get().partitionId()
        rows = [(t, c, slot, zlib.compress(x, 1)) for t in range(MOST - 1) for c, x in enumerate(tables[t].reshape(-1, CHUNK)) if x.any()]
        yield pa.RecordBatch.from_pylist([dict(zip(SURVEY.names, (None,) * 5 + r, strict=True)) for r in rows], SURVEY)

    found = stored(_texts(docs).mapInArrow(run, "lang string, w1 string, w2 string, w3 string, n long, level int, chunk int, slot int, data binary"), "survey")
    places = _often(found.where("level is not null").select("level", "chunk", "slot", "data"), cap)
    found = stored(found.where("level is null").groupBy("lang", *WORDS[:3]).agg(F.sum("n").alias("n")), "prefixes")
    totals = {r["lang"]: r["n"] for r in found.where("w1 is null").collect()}  # a row a language
    share = sum(totals.values()) // parts
    return found.where((F.col("n") > share) & F.col("w1").isNotNull()), totals, places


SURVEY = pa.schema([*((c, pa.string()) for c in ("lang", *WORDS[:3])), ("n", pa.int64()), ("level", pa.int32()), ("chunk", pa.int32()), ("slot", pa.int32()), ("data", pa.binary())])


def _often(rows: DataFrame, cap: int) -> list[np.ndarray]:
    """The tables of all tasks added up, FAN at a time, as arrays of booleans: of fixed size."""

    def add(t: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.uint8)
        for x in t.column("data"):
            total = np.minimum(total.astype(np.int64) + np.frombuffer(zlib.decompress(x.as_py()), np.uint8), cap).astype(np.uint8)
        return t.slice(0, 1).select(["level", "chunk", "slot"]).append_column("data", pa.array([zlib.compress(total, 1)], pa.binary()))

    slots = (rows.agg(F.max("slot")).first()[0] or 0) + 1
    while slots > 1:
        rows = rows.withColumn("slot", F.floor(F.col("slot") / FAN).cast("int"))
        rows = stored(rows.groupBy("level", "chunk", "slot").applyInArrow(add, "level int, chunk int, slot int, data binary"), "tables")
        slots = -(-slots // FAN)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            packed = [np.packbits(np.frombuffer(zlib.decompress(x.as_py()), np.uint8) >= cap).tobytes() for x in b.column("data")]
            yield pa.RecordBatch.from_arrays([b.column("level"), b.column("chunk"), pa.array(packed, pa.binary())], ["level", "chunk", "data"])

    out = np.zeros((MOST - 1, (1 << BITS) // CHUNK, CHUNK), bool)
    for r in rows.mapInArrow(bits, "level int, chunk int, data binary").collect():  # 2 ** BITS bits each
        out[r["level"], r["chunk"]] = np.unpackbits(np.frombuffer(r["data"], np.uint8)).astype(bool)
    return list(out.reshape(MOST - 1, -1))


def _prefixes(block: Block, lang: np.ndarray, n: np.ndarray, words: list[np.ndarray]) -> pa.RecordBatch:
    named = [block.names.take(pa.array(w)) for w in words] + [pa.nulls(len(n), pa.string())] * (MOST - 1 - len(words))
    rest = [pa.nulls(len(n), f.type) for f in list(SURVEY)[MOST + 1 :]]
    return pa.RecordBatch.from_arrays([block.langs.dictionary.take(pa.array(lang)), *named, pa.array(n), *rest], schema=SURVEY)


def suffixes(docs: DataFrame, heavy: set[tuple[str, ...]], often: list[np.ndarray] | None = None, size: int = BLOCK_WORDS) -> DataFrame:
    """lang, w1..w4 (null after the end), n, depth, deal: the suffixes of every task, cut by often.

    depth is the length of the shortest prefix that is not hot; its words, but for the first, make deal,
    one of 2**DEAL_BITS numbers. Rows with equal lang, w1, depth and deal come in runs."""
    return _texts(docs).mapInArrow(_suffix_batches(heavy, often, size), "lang string, w1 string, w2 string, w3 string, w4 string, n long, depth int, deal int")


def tails(docs: DataFrame, heavy: set[tuple[str, ...]], often: list[np.ndarray] | None = None, size: int = BLOCK_WORDS) -> DataFrame:
    """lang, w1, depth, deal, tails, n: the same suffixes, those of a task with equal lang, w1, depth
    and deal as one row: tails, a line each of what follows w1, and n, their counts."""
    make = _suffix_batches(heavy, often, size)
    return _texts(docs).mapInArrow(lambda batches: map(_listed, make(batches)), "lang string, w1 string, depth int, deal int, tails string, n array<int>")


def _listed(b: pa.RecordBatch) -> pa.RecordBatch:
    """Suffixes whose first words come in runs, a row a run."""
    new = np.ones(b.num_rows, bool)
    for c in (keys := ["lang", "w1", "depth", "deal"]):
        col = b.column(c)
        new[1:] = (new[1:] if c != "lang" else False) | pc.not_equal(col.slice(1), col.slice(0, b.num_rows - 1)).to_numpy(zero_copy_only=False)
    starts = np.flatnonzero(new)
    edges = pa.array(np.append(starts, b.num_rows), pa.int32())
    tail = pc.utf8_rtrim(pc.binary_join_element_wise(*(b.column(w).fill_null("") for w in WORDS[1:]), " "), " ")  # no word holds a space
    text = pc.binary_join(pa.ListArray.from_arrays(edges, tail), "\n")
    n = pa.ListArray.from_arrays(edges, b.column("n").cast(pa.int32()))
    return pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(starts)) for c in keys), text, n], [*keys, "tails", "n"])


def _suffix_batches(heavy: set[tuple[str, ...]], often: list[np.ndarray] | None, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What makes suffixes of texts, those of a task in runs."""
    packed = None if often is None else [np.packbits(x) for x in often]
    names = ["lang", *WORDS, "n", "depth", "deal"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        able, held = None if packed is None else [np.unpackbits(x).astype(bool) for x in packed], Held()
        for block, end in _blocks(batches, size):
            if able is not None:
                block.cut(able)
            held.add(block, end)
            del block
            if held.size > KEPT or held.names.nbytes > 8 * KEPT or held.found > 1 << 30:
                held.fold()
                if held.size > KEPT - KEPT // 4 or held.names.nbytes > 8 * KEPT or held.found > 1 << 30:
                    yield from dealt(held)
                    held = Held()
        held.fold()
        yield from dealt(held)

    def dealt(held: Held) -> Iterator[pa.RecordBatch]:
        langs = pa.array(held.langs, pa.string())
        for i in range(0, held.size, BLOCK_WORDS):
            (lang, *words), n = held.codes[0][:, i : i + BLOCK_WORDS], held.n[0][i : i + BLOCK_WORDS]
            lang_text = langs.take(pa.array(lang))
            text = [held.names.take(pa.array(w)) for w in words]
            depth, live = np.ones(len(n), np.int32), np.arange(len(n))
            deal = np.zeros(len(n), np.uint64)
            for k in range(1, MOST) if heavy else ():  # rows are in order, so a prefix is one run
                if not len(live):
                    break
                begins = np.append(True, np.any([np.diff(x[live]) != 0 for x in (lang, *words[:k])], axis=0))
                heads = pa.array(live[begins])
                is_hot = np.fromiter((p in heavy for p in zip(*(c.take(heads).to_pylist() for c in (lang_text, *text[:k])), strict=True)), bool, len(heads))
                live = live[is_hot[np.cumsum(begins) - 1]]
                depth[live] = k + 1
            for k in range(1, MOST):
                rows = np.flatnonzero(depth > k)
                deal[rows] = (deal[rows] + held.hashes[words[k][rows]]) * ODD
            deal = (deal >> np.uint64(64 - DEAL_BITS)).astype(np.int32)
            out = pa.RecordBatch.from_arrays([lang_text, *text, pa.array(n), pa.array(depth), pa.array(deal)], names)
            yield out.take(pa.array(np.lexsort((deal, depth, words[0], lang))))

    return run


def hash_of(word: str | None) -> int:
    """The same on every executor, unlike Python's own."""
    import xxhash

    return xxhash.xxh64_intdigest((word or "\n").encode())


def prefix_counts(lists: DataFrame, min_count: int, most: int = HELD) -> DataFrame:
    """lang, w1..w4, n: the prefixes of tails, sorted by lang, w1 and deal, found min_count times; counts
    of hot ones, and of first words with over most suffixes, are parts of their sums, of whatever size."""
    names, keys = ["lang", *WORDS], ["lang", "w1", "deal"]

    def counted(t: pa.Table, part: bool) -> Iterator[pa.RecordBatch]:
        if not t.num_rows:
            return
        b = t.combine_chunks().to_batches()[0]
        lines = pc.split_pattern(b.column("tails"), "\n")
        parent, n = pc.list_parent_indices(lines), pc.list_flatten(b.column("n")).to_numpy()
        words = pc.split_pattern(pc.list_flatten(lines), " ")
        at, length = words.offsets.to_numpy(), pc.list_value_length(words).to_numpy()
        up, depth = parent.to_numpy(), b.column("depth").to_numpy()
        live, code = np.arange(len(n)), np.zeros(len(n), np.int64)
        for k in range(MOST + 1):
            if k < 2:
                coded = b.column(names[k]).dictionary_encode()
                word = coded.indices.to_numpy()[up[live]]
            else:  # the empty text is one empty word
                coded = words.values.dictionary_encode() if k == 2 else coded
                stay = length[live] >= k - 1
                live, code = live[stay], code[stay]
                word = coded.indices.to_numpy()[at[live] + k - 2]
                empty = coded.dictionary.index("").as_py()
                live, code, word = (x[word != empty] for x in (live, code, word))
            _, first, code = np.unique(code * len(coded.dictionary) + word, return_index=True, return_inverse=True)
            if k == 0 or not len(live):
                continue
            sums = np.bincount(code, n[live]).astype(np.int64)
            lead = live[first]
            keep = np.flatnonzero((sums >= min_count) | (depth[up[lead]] > k) | part)
            lead = lead[keep]
            cols = [b.column(c).take(pa.array(up[lead])) for c in names[:2]] + [words.values.take(pa.array(at[lead] + i)) for i in range(k - 1)]
            yield pa.RecordBatch.from_arrays([*cols, *[pa.nulls(len(keep), pa.string())] * (MOST - k), pa.array(sums[keep])], [*names, "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size, begun = 0, None  # the first word a part of which is counted

        def same(t: pa.Table, key: tuple | None) -> np.ndarray:
            if key is None:
                return np.zeros(t.num_rows, bool)
            return np.all([pc.equal(t[c], pa.scalar(x, t[c].type)).to_numpy() for c, x in zip(keys, key, strict=True)], axis=0)

        def whole(t: pa.Table) -> Iterator[pa.RecordBatch]:
            rest = int(np.sum(same(t, begun)))  # rows are in order, so these lead
            yield from counted(t.slice(0, rest), True)
            yield from counted(t.slice(rest), False)

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            size += len(pc.list_flatten(b.column("n")))
            if size < most:
                continue
            t = pa.Table.from_batches(held)
            last = tuple(t[c][-1].as_py() for c in keys)
            cut = t.num_rows - int(np.sum(same(t, last)))
            if cut:
                yield from whole(t.slice(0, cut))
                held, begun = t.slice(cut).to_batches(), begun if begun == last else None
            else:
                yield from counted(t, True)
                held, begun = [], last
            size = sum(len(pc.list_flatten(x.column("n"))) for x in held)
        if held:
            yield from whole(pa.Table.from_batches(held))

    return lists.mapInArrow(run, ", ".join(f"{c} string" for c in names) + ", n long")


def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, parts: int = HOT_PARTS, size: int = BLOCK_WORDS) -> tuple[DataFrame, dict[str, int]]:
    """lang, words (array of 1 to MOST), n of all phrases found min_count times, and each language's words. Stored."""
    found, totals, often = survey(docs, min_count, parts, size)
    heavy = {tuple(x for x in r if x is not None) for r in found.select("lang", *WORDS[:3]).collect()}  # under 3 * parts
    dealt = tails(docs, heavy, often, size).repartition("lang", "w1", "deal").sortWithinPartitions("lang", "w1", "deal")
    counts = prefix_counts(dealt, min_count)
    counts = counts.groupBy("lang", F.filter(F.array(*WORDS), lambda x: x.isNotNull()).alias("words")).agg(F.sum("n").alias("n"))
    return stored(counts.where(F.col("n") >= min_count), "phrases"), totals


def _with_part(cuts: DataFrame, counts: DataFrame, part: str, name: str) -> DataFrame:
    """cuts with the count of the phrase in column part; parts of many cuts are dealt over salts."""
    keys = ["lang", part]
    per = stored(cuts.groupBy(*keys).agg(F.count("*").alias("cuts")).join(counts.select("lang", F.col("words").alias(part), F.col("n").alias(name)), keys), "parts")
    busy = hot_keys(per, keys, "cuts", per.agg(F.sum("cuts")).first()[0] or 0)
    return salted(cuts, per.drop("cuts"), keys, ["words", "k"], busy)


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, percent: int = PERCENT, top: int = TOP, **how) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first ``top`` phrases of two words and more."""
    counts, totals = phrase_counts(docs, min_count, **how)
    exact = lambda x, factor: F.lit(factor).cast("decimal(10,0)") * x.cast("decimal(20,0)")
    long = counts.where("size(words) > 1").select("lang", "words", F.col("n").alias("a"))
    cuts = long.select("lang", "words", "a", F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "words", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("left"), F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("right"))
    cuts = _with_part(_with_part(cuts, counts, "left", "l"), counts, "right", "r")
    cuts = cuts.withColumn("num", exact(F.col("a"), 2_000_000)).withColumn("den", (F.col("l") + F.col("r")).cast("decimal(20,0)"))
    scored = cuts.withColumn("score", F.expr("num div den")).groupBy("lang", "words").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("s"))

    spans = F.expr("filter(flatten(transform(sequence(2, size(words) - 1), m -> transform(sequence(1, size(words) - m + 1), i -> slice(words, i, m)))), x -> true)")
    within = long.where("size(words) > 2").select("lang", F.explode(F.array_distinct(spans)).alias("words"), F.col("a").alias("longer")).groupBy("lang", "words").agg(F.max("longer").alias("longer"))
    df = scored.join(within, ["lang", "words"], "left")
    df = df.where(F.col("longer").isNull() | (exact(F.col("longer"), 100) < exact(F.col("s.a"), percent)))
    phrase: Column = F.array_join("words", " ")
    df = df.select("lang", phrase.alias("phrase"), "s.a", "s.l", "s.r", "s.score")
    df = df.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")).cast("long")).where(F.col("rank") <= top)
    n = df.sparkSession.createDataFrame(list(totals.items()), "lang string, n long")  # a row a language
    return df.join(F.broadcast(n), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
