"""Training-data queries against DuckDB, or against plain Python where SQL cannot express them."""

import collections
import hashlib
import struct
import zlib

import duckdb
import pytest

import corpus_pipeline
from somaspark.llm import q_pack, queries
from somaspark.llm.common import tokenizer_path
from somaspark.llm.media import wav_of

DATA = "/root/testdata/sf0.001"
TABLES = "documents pages conversations labels benchmark".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.fixture(scope="module")
def docs(con):
    return {i: t or "" for i, t in con.execute("SELECT doc_id, text FROM documents").fetchall()}


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, con, name):
    df = queries.queries()[name](spark, DATA)
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, want.fetchall()))


def check_packing(rows, texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    ids = {i: e.ids + [2] for (i, _), e in zip(texts.items(), t.encode_batch(list(texts.values()), add_special_tokens=False), strict=True)}
    pieces, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and r.doc_tokens == len(ids[r.doc_id]) and zlib.crc32(struct.pack(f"<{len(own)}I", *own)) == r.ids_crc32
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(texts)
    pad = 0
    for parts, ends in ((pieces, {i: len(x) for i, x in ids.items()}), (windows, None)):
        for key, found in parts.items():
            at = 0
            for start, length in sorted(found):
                assert start == at
                at += length
            assert at == ends[key] if ends else at <= 4096
            pad += 0 if ends else 4096 - at
    assert pad < 4096


def test_packing(spark, docs):
    check_packing(queries.queries()["op8_packing"](spark, DATA).collect(), docs)


def test_media(spark, docs):
    for r in queries.queries()["op6_media_columns"](spark, DATA).collect():
        b = docs[r.doc_id].encode()
        p = b + b" " * (-len(b) % 192 if b else 192)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]))
        assert (r.media_bytes, r.media_sha256) == (len(wav_of(p)), hashlib.sha256(wav_of(p)).hexdigest())


def test_pieces_come_back(spark, docs):
    rows = queries.queries()["op3_sentencepiece"](spark, DATA).collect()
    assert len(rows) == len(docs) and all(r.exact for r in rows)
    assert all(r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest() for r in rows)


def test_language_accuracy_on_held_out_documents(spark, con):
    lang = dict(con.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = queries.queries()["op7_language_id"](spark, DATA).collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == len(lang) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) / len(held) > 0.95 and all(0 <= r.score <= 1 for r in rows)


def test_urls(spark, con):
    from somaspark.llm.q_url import RULES

    def fixed(host, path):
        fits = [r for r in RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        return max(fits, key=lambda r: len(r[0] + r[1]), default=None)

    urls = dict(con.execute("SELECT page_id, url FROM pages").fetchall())
    for r in queries.queries()["op9_url_filter"](spark, DATA).collect():
        rest = urls[r.page_id].split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail] or [len(tail)])]
        rule = fixed(rest[:cut].lower(), path)
        assert (r.host, r.path, r.rule) == (rest[:cut].lower(), path, rule and rule[0] + rule[1])
        assert r.verdict == (rule[2] if rule else r.mined)


def test_pipeline(spark):
    got = corpus_pipeline.run(spark, DATA).collect()
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    start = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, d, DATA).cache()
        assert new.columns == start.columns, name
        assert not {r.doc_id for r in new.select("doc_id").collect()} - {r.doc_id for r in d.select("doc_id").collect()}
        d = new
    check_packing(got, {r.doc_id: r.text or "" for r in d.select("doc_id", "text").collect()})
    assert q_pack.packed(d).count() == len(got)
