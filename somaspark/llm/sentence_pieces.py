"""SentencePiece encoding and decoding of whole texts with the unigram search of ``unigram``.

The trie's arrays are built once on the driver (their size is the vocabulary's) and broadcast.

Defined results: a null text has null ids, an empty one the ids of the marker alone; decoding gives
every text back exactly, whatever its white space; repeated rows have equal results, each its own;
a very long text is searched unit by unit, and a unit of any length alone if it has to be; an empty
table gives an empty table; other columns stay (a column named like a new one is replaced).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tokenizer_path
from .unigram import load

CACHE, CACHED_CHARS = 400_000, 256  # units held between batches, and their longest


def _mapped(df: DataFrame, new: dict[str, str], column: str, work) -> DataFrame:
    """df with the columns new, made by work(texts or ids of a batch) -> lists."""
    keep = [c for c in df.columns if c not in new]
    kinds = {"binary": pa.binary(), "string": pa.string(), "long": pa.int64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = work()
        for whole in batches:
            for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                made = f(b.column("value").to_pylist())
                yield pa.RecordBatch.from_arrays([*b.column("row").flatten(), *(pa.array(x, kinds[k]) for x, k in zip(made, new.values(), strict=True))], [*keep, *new])

    schema = df.select(*[F.col(f"`{c}`") for c in keep]).schema
    for c, k in new.items():
        schema = schema.add(c, k)
    return df.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(column).alias("value")).mapInArrow(run, schema)


def encode(df: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """df with ids (binary, little-endian unsigned 32-bit), n_tokens and n_byte_tokens."""
    model = df.sparkSession.sparkContext.broadcast(load(path or tokenizer_path("piece_bpe_32k.model")))

    def work():
        m, cache = model.value, {}
        fallback = set(m.bytes.tolist())

        def f(texts: list[str | None]) -> tuple[list, list, list]:
            split = [None if x is None else m.units(x) for x in texts]
            wanted = set().union(*filter(None, split))
            if len(cache) + len(wanted) > CACHE:
                cache.clear()
            new = list(wanted - cache.keys())
            own = {}
            for u, ids in zip(new, m.segment(new), strict=True):
                (cache if len(u) <= CACHED_CHARS else own)[u] = struct.pack(f"<{len(ids)}I", *ids), sum(i in fallback for i in ids)
            got = [None if s is None else [cache[u] if u in cache else own[u] for u in s] for s in split]
            ids = [None if s is None else b"".join([x for x, _ in s]) for s in got]
            return ids, [None if x is None else len(x) // 4 for x in ids], [None if s is None else sum([n for _, n in s]) for s in got]

        return f

    return _mapped(df, {"ids": "binary", "n_tokens": "long", "n_byte_tokens": "long"}, text, work)


def decode(df: DataFrame, path: str | None = None, ids: str = "ids") -> DataFrame:
    """df with decoded (string)."""
    model = df.sparkSession.sparkContext.broadcast(load(path or tokenizer_path("piece_bpe_32k.model")))

    def work():
        m = model.value
        return lambda rows: ([None if x is None else m.decode(struct.unpack(f"<{len(x) // 4}I", x)) for x in rows],)

    return _mapped(df, {"decoded": "string"}, ids, work)
