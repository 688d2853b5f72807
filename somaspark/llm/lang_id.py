"""Language ID by a bidirectional gated recurrent network over bytes.

``fit`` learns from a bounded sample: id hashes fall into ``docs_per_lang`` bins, and of each of the
``MOST_LANGS`` most frequent languages the document of least hash in each bin is taken, of it a
window of ``window_chars`` characters at a hashed place. ``predict`` reads every whole text: its
UTF-8 bytes are cut into sequences of ``LENGTH``, the network labels every position, and a
document's probabilities are the means over all its positions.

Defined results: a null text or one without a letter is ``und`` with score 0, and so is every text
if nothing could be learned; equal texts get equal results; ties go to the language that sorts
first; rows that repeat a doc_id give one window a language (the least), and each row its own
result; a very long text counts as a whole, in slices of ``SLICE`` sequences; an empty table gives
an empty table; extra columns are ignored or, in ``predict``, kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_gru import Params, position_probs, train

LENGTH, SLICE = 96, 2048
DOCS_PER_LANG, WINDOW_CHARS, MOST_LANGS = 256, 600, 128  # the driver gets their product in characters at most


def sequences(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin and size of each sequence, the text it belongs to, and the number of sequences of each text."""
    n = -(-sizes // length)
    owner = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    begin = starts[owner] + k * length
    return begin, np.minimum(length, sizes[owner] - k * length), owner, n


def matrix(data: np.ndarray, begin: np.ndarray, size: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(length, sequences) bytes and mask."""
    at = np.arange(length)[:, None]
    mask = at < size
    return data[np.where(mask, begin + at, 0)] * mask.astype(np.uint8), mask.astype(np.float32)


def sampled(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, window_chars: int = WINDOW_CHARS, most_langs: int = MOST_LANGS) -> DataFrame:
    """lang, x: at most ``docs_per_lang`` windows of each of the most frequent languages.

    The picks are minima of one long a bin, so tasks combine them before the shuffle and no key
    gathers more than that; rows that repeat a doc_id share a hash and end as one window."""
    ok = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select(F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("doc_id").cast("string")).alias("h"), "text")
    bins = ok.groupBy("lang", F.pmod("h", F.lit(docs_per_lang)).alias("bin")).agg(F.min("h").alias("h"), F.count("*").alias("n"))
    langs = bins.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(most_langs).select("lang")
    picked = bins.join(F.broadcast(langs), "lang").select("lang", "h")
    at = F.pmod(F.col("h"), F.greatest(F.lit(1), F.length("text") - window_chars)).cast("int") + 1
    found = ok.join(F.broadcast(picked), ["lang", "h"]).select("lang", "h", F.substring("text", at, F.lit(window_chars)).alias("x"))  # docs_per_lang rows a language
    return found.groupBy("lang", "h").agg(F.min("x").alias("x")).select("lang", "x")


def fit(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, window_chars: int = WINDOW_CHARS) -> tuple[list[str], Params | None]:
    """The languages in order and the network, from rows of doc_id, text and lang."""
    rows = sampled(docs, docs_per_lang, window_chars)
    got = sorted((r["lang"], r["x"]) for r in rows.collect())
    langs = sorted({lang for lang, _ in got})
    if not langs:
        return [], None
    texts = [x.encode() for _, x in got]
    sizes = np.array([len(x) for x in texts])
    data = np.frombuffer(b"".join(texts), np.uint8)
    begin, size, owner, _ = sequences(data, np.cumsum(sizes) - sizes, sizes, LENGTH // 2)
    labels = np.array([langs.index(lang) for lang, _ in got])[owner]
    return langs, train(*matrix(data, begin, size, LENGTH // 2), labels, len(langs))


def text_probs(p: Params, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(texts, classes): mean position probabilities; zero for an empty text."""
    begin, size, owner, _ = sequences(data, starts, sizes)
    total = np.zeros((len(sizes), len(p["c"])))
    order = np.argsort(-size, kind="stable")  # the short tails together at the end
    for i in range(0, len(order), SLICE):
        o = order[i : i + SLICE]
        sums = position_probs(p, *matrix(data, begin[o], size[o], int(size[o[0]])))
        np.add.at(total, owner[o], sums.T.astype(float))
    return total / np.maximum(sizes, 1)[:, None]


def predict(docs: DataFrame, langs: list[str], p: Params | None) -> DataFrame:
    """docs with lang_pred and score (columns of these names are replaced)."""
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(i, 1024) for i in range(0, whole.num_rows, 1024)):
                letters = np.array(b.column("letters").to_pylist(), bool)
                pred, score = np.full(len(letters), "und", object), np.zeros(len(letters))
                if p is not None and letters.any():
                    texts = [x.encode() if k else b"" for x, k in zip(b.column("text").to_pylist(), letters, strict=True)]
                    sizes = np.array([len(x) for x in texts], np.int64)
                    probs = text_probs(p, np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes)
                    best = probs.argmax(1)
                    pred[letters] = np.array(langs, object)[best[letters]]
                    score[letters] = np.clip(probs[np.arange(len(best)), best], 0, 1)[letters]
                yield pa.RecordBatch.from_arrays([*b.column("row").flatten(), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    row = F.struct(*[F.col(f"`{c}`") for c in keep])
    df = docs.select(row.alias("row"), F.col("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    kinds = docs.select(*[F.col(f"`{c}`") for c in keep]).schema.add("lang_pred", "string").add("score", "double")
    return df.mapInArrow(run, kinds)


def language_filter(docs: DataFrame, min_score: float = 0.35) -> DataFrame:
    """docs without those of no language (``und``) or of a best score under min_score; the same columns."""
    df = predict(docs.withColumnsRenamed({c: f"{c}__own" for c in docs.columns if c in ("lang_pred", "score")}), *fit(docs))
    df = df.where((F.col("lang_pred") != "und") & (F.col("score") >= min_score)).drop("lang_pred", "score")
    return df.withColumnsRenamed({f"{c}__own": c for c in docs.columns if c in ("lang_pred", "score")})
