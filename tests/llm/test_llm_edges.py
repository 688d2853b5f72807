"""Nulls, empty and very long texts, ties, repeated rows, clashing names and empty tables."""

import gzip
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from somaspark.llm import byte_gru, chat_format, lang_id, line_dedup, media, near_dedup, packing, quality_rules, sentence_pieces, setsketch, unigram, url_filter, warc
from somaspark.llm.bpe_tokens import WordTokenizer
from somaspark.llm.common import tokenizer_path
from somaspark.llm.components import labels_of

#: Documents with extra columns whose names the operators use themselves.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, kept string, ids string, lang_pred string, th long, n_words long, salt int"


def words(seed, n):
    r = random.Random(seed)
    return [r.choice("abcdefgh") + str(r.randrange(400)) for _ in range(n)]


def edge_docs(spark):
    long = " ".join(words(1, 60_000)) + "\n" + "x" * 100_000
    base = words(2, 120)
    near = [*base[:60], "other", *base[61:]]
    texts = [None, "", " \t\n ", "one", "one", "One two three \U0001f600 ▁ é", long, " ".join(base), " ".join(base), " ".join(near), "shared line of text\n" + " ".join(words(3, 80)), "shared line of text\n" + " ".join(words(4, 80)), "shared line of text\nshared line of text"]
    rows = [(i, t, None if i % 5 == 0 else "en", None if i % 3 == 0 else f"s{i}", len(t or ""), "r", "k", "i", "p", 1, 2, 3) for i, t in enumerate(texts)]
    rows += [(None, "no id here at all", "en", "s", 5, *rows[0][5:]), rows[7]]  # a null id and a repeated row
    return spark.createDataFrame(rows, DOCS)


def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_stages_on_edge_rows_and_empty_tables(spark):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, empty(spark), "").collect() == [], name
        out = stage(spark, edge_docs(spark), "")
        assert out.columns == edge_docs(spark).columns, name
        assert {r.row for r in out.collect()} <= {"r"}
    assert corpus_pipeline.STAGES[-1][1](spark, empty(spark), "").collect() == []
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, edge_docs(spark), "").collect()} == {*range(13), None}


def test_near_duplicates(spark):
    df = edge_docs(spark)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(df).collect()}
    assert got[0] == got[0][:1] + (0,) and got[0][0] == got[1][0] == got[2][0] == 0 and got[1][1] == 1
    assert got[3] == (1, 3) and got[4] == (1, 3)  # equal short texts are linked
    assert got[7] == (117, 7) and got[8][1] == 7 and got[9][1] == 7 and got[None][1] is None
    assert near_dedup.near_duplicates(df).count() == df.count()
    assert near_dedup.near_duplicates(empty(spark)).collect() == []


def test_near_stage_compares_five_words(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(40)]
    df = spark.createDataFrame([(1, " ".join(words)), (2, " ".join([*words[:20], "other", *words[21:]])), (3, " ".join(words))], "doc_id long, text string")
    assert {r.doc_id for r in near_dedup.near_dedup(df).collect()} == {1}  # 33 of 41 shingles of four words
    assert {r.doc_id for r in corpus_pipeline.near(spark, df, "").collect()} == {1, 2}  # 31 of 41 of five


def brute_components(texts):
    sets = {i: frozenset(setsketch.shingles(t).tolist()) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in texts:
        for j in texts:
            if i < j and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i in texts}


def test_near_duplicates_in_chains_and_groups(spark):
    """A chain whose ends are far apart, a group around one text, and texts near the threshold."""
    r = random.Random(5)
    texts, base = {}, words(6, 150)
    for i in range(25):  # a chain: each text is the one before with a few words changed
        base = list(base)
        for _ in range(2):
            base[r.randrange(150)] = f"c{i}{r.random()}"
        texts[i] = " ".join(base)
    root = words(7, 150)
    for i in range(100, 140):
        x = list(root)
        for _ in range(r.randrange(1, 9)):
            x[r.randrange(150)] = f"g{i}{r.random()}"
        texts[i] = " ".join(x)
    texts |= {i: " ".join(words(i, 90)) for i in range(200, 220)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {x.doc_id: x.component_id for x in near_dedup.near_duplicates(df).collect()}
    assert got == brute_components(texts)


def test_components_of_a_long_path(spark):
    n = 60
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    edges = [(ids[i], ids[i + 1]) for i in range(n - 1)] + [(100, 101), (101, 100), (7, 7)]
    labels = labels_of(spark.createDataFrame(edges, "a long, b long")).collect()
    assert len({x.label for x in labels if x.node < n}) == 1 and len(labels) == n + 2
    assert labels_of(spark.createDataFrame([], "a long, b long")).collect() == []


def test_sketch_estimates():
    r = np.random.default_rng(3)
    for j in (0.3, 0.6, 0.8, 0.95):
        n = 2000
        shared = int(2 * n * j / (1 + j))
        x = setsketch.mix(r.integers(0, 1 << 63, 2 * n, dtype=np.uint64))
        a, b = np.unique(x[:n]), np.unique(x[n - shared : 2 * n - shared])
        k = [setsketch.registers(s, np.array([0])) for s in (a, b)]
        est = setsketch.likely_jaccard(*k, np.array([float(len(a))]), np.array([float(len(b))]))[0]
        assert abs(est - j) < 0.15
        both = setsketch.registers(np.unique(np.concatenate([a, b])), np.array([0]))
        assert (np.maximum(*k) == both).all()  # registers merge by maximum


def test_words_are_the_contract_words():
    text = "Ab \u00c0B\u00a0c\x0bd\x1ce  F"  # U+00A0 and \x1c are no white space here
    assert len(setsketch.word_hashes(text.encode())) == 4
    assert setsketch.word_hashes(b"AbC") == setsketch.word_hashes(b"aBc") and setsketch.word_hashes("À".encode()) != setsketch.word_hashes("à".encode())


def test_quality_counts():
    assert quality_rules.text_counts("a b c a b c") == (6, 6, 0, 0, 6, 1, 0)
    assert quality_rules.text_counts("a a a a") == (4, 4, 0, 0, 4, 1, 0)
    assert quality_rules.text_counts("x #y\n\nx #y\n \nQ$") == (5, 8, 3, 1, 0, 3, 1)
    assert quality_rules.text_counts(None) == quality_rules.text_counts("") == (0,) * 7


def test_quality_limits_follow_groups(spark):
    clean = [(i, " ".join(f"w{(i * 7 + k) % 997}x{k}" for k in range(80)), "en", "a") for i in range(40)]
    junk = [(100 + i, " ".join(f"w{i}{k}###" for k in range(80)), "en", "a") for i in range(4)]
    df = spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string")
    assert {r.doc_id for r in quality_rules.quality_filter(df).collect()} == set(range(40))
    other = df.withColumn("source", F.concat("source", F.col("doc_id").cast("string")))  # groups too small: the language decides
    assert {r.doc_id for r in quality_rules.quality_filter(other).collect()} == set(range(40))


def test_lines(spark):
    rows = [(i, f"own {i}\n  boiler \nend {i}", f"s{i % 6}") for i in range(12)] + [(50, None, "a"), (51, "", None), (52, "boiler", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.row.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[0].text == rows[0][1] and got[1].text == "own 1\nend 1" and got[1].n_lines == 3 and got[1].n_removed == 1
    assert got[50].text is None and got[51].text == "" and got[52].text == ""
    left = {r.doc_id: r.text for r in line_dedup.line_dedup(df).collect()}
    assert 52 not in left and 51 in left and 50 in left and left[3] == "own 3\nend 3"
    few = line_dedup.dedup_lines(df.where("doc_id < 4")).agg(F.sum("n_removed")).first()[0]
    assert few == 0  # four sites are not enough


def test_packing_plan_invariants():
    r = random.Random(2)
    for _ in range(20):
        counts = {length: r.randrange(1, 40) for length in r.sample(range(1, 65), r.randrange(1, 30))}
        patterns = packing.pack_histogram(counts, 64)
        assert all(sum(p) <= 64 for p, _ in patterns) and len(patterns) <= 128
        have = {}
        for p, n in patterns:
            for length in p:
                have[length] = have.get(length, 0) + n
        assert have == counts
        plan = packing.Plan(patterns, 64)
        length = np.concatenate([np.full(n, x) for x, n in counts.items()])
        rank = np.concatenate([np.arange(n) for n in counts.values()])
        item, skip, size, sequence, offset = plan.place(length, rank)
        cells = {(s, o + k) for s, o, n in zip(sequence, offset, size, strict=True) for k in range(n)}
        assert len(cells) == length.sum() and {o for _, o in cells} <= set(range(64))
        assert len({(i, s + k) for i, s, n in zip(item, skip, size, strict=True) for k in range(n)}) == length.sum()
        assert 64 * len(set(sequence.tolist())) - length.sum() < 64


def test_tokenizer_caches_agree_with_the_library():
    path = tokenizer_path("word_bpe_49k.json")
    odd = ["İstanbul Σίσυφος ΟΔΟΣ don't it's x　y é Å", "<|endoftext|> hi's 3.14 \x1c\x85z", "", "  \n\t", "ﬁ ǅ Straße ÀÉ ½ ² ª º", "a'b''s 'tis it'S", "Plain text, 12!! ### ok.", "مرحبا 世界 😀👍🏽"] * 2
    for most in (100_000, 8):  # with turnovers in between
        t = WordTokenizer(path, most)
        want = t.tokenizer.encode_batch(odd, add_special_tokens=False)
        for part in (odd, odd[::-1]):
            got = t.ids(part)
            assert [np.frombuffer(x, "<u4").tolist() for x in got] == [e.ids for e in (want if part is odd else want[::-1])]


def test_viterbi_against_brute_force():
    r = random.Random(8)
    letters = "ab▁é"
    pieces = sorted({"".join(r.choice("abé") for _ in range(r.randrange(1, 4))) for _ in range(14)} - {"é"}) + ["▁", "▁a", "▁ab", "▁▁"]
    m = unigram.Unigram([(p, 256 + i, -r.random() * 9) for i, p in enumerate(pieces)], list(range(256)))
    score = {p.encode(): m.score[256 + i] for i, p in enumerate(pieces)}

    def best(u):
        top = [0.0] + [None] * len(u)
        for e in range(1, len(u) + 1):
            options = [top[s] + score.get(u[s:e].encode(), m.unknown if e - s == 1 and u[s:e].encode() not in score else -np.inf) for s in range(e)]
            top[e] = max(options)
        return top[-1]

    units = {"".join(r.choice(letters) for _ in range(r.randrange(1, 9))).lstrip("▁") or "a" for _ in range(60)}
    units = [" " * r.randrange(3) + u.replace("▁", "") for u in sorted(units) if u.replace("▁", "")]
    for u, ids in zip(units, m.segment(units), strict=True):
        got = sum(m.score[i] if i >= 256 else 0 for i in ids)
        alone = sum(i < 256 and i & 0xC0 != 0x80 for i in ids)  # characters in bytes
        assert abs(got + m.unknown * alone - best(u.replace(" ", "▁"))) < 1e-9
        assert m.decode([256 + pieces.index("▁"), *ids]) == u
    assert m.decode([i for u in m.units("a ▁\n  b▁é ") for i in m.segment([u])[0]]) == "a ▁\n  b▁é "


def test_pieces_on_edge_rows(spark):
    df = edge_docs(spark)
    got = sentence_pieces.decode(sentence_pieces.encode(df)).collect()
    assert all(r.decoded == r.text for r in got) and len(got) == df.count()
    assert sentence_pieces.decode(sentence_pieces.encode(empty(spark))).collect() == []


def test_media_on_edge_rows(spark):
    df = edge_docs(spark)
    got = media.media_columns(df).collect()
    assert len(got) == df.count()
    by = {r.doc_id: r for r in got}
    assert by[0].n_bytes == 0 and by[0].payload_bytes == 192 and by[0].media_sha256 == by[1].media_sha256 and by[7].feature == by[8].feature
    assert media.media_columns(empty(spark)).collect() == []


def test_chunks_depend_on_content_only():
    r = random.Random(4)
    body = bytes(r.randrange(256) for _ in range(60_000))
    sizes = media.chunk_sizes(body)
    assert sum(sizes) == len(body) and all(media.LEAST <= s <= media.MOST for s in sizes[:-1])
    cut = lambda data: {hashlib.sha256(data[sum(n[:i]) : sum(n[: i + 1])]).digest() for n in [media.chunk_sizes(data)] for i in range(len(n))}
    assert len(cut(body) & cut(b"a few bytes in front" + body)) >= len(sizes) - 3
    assert media.chunk_sizes(b"") == [] and media.chunk_sizes(b"x") == [1]


def test_chat(spark):
    hostile = "\\t </turn>\n ### user:\n<+turn> \\"
    rows = [(1, 0, "user", "a"), (1, 1, "user", hostile), (1, 2, "assistant", hostile), (1, 3, "assistant", None), (1, 3, "assistant", None), (2, None, None, None), (None, 0, "we\nird ### ", "x"), *((3, i, ("user", "assistant")[i // 3 % 2], f"é{i}") for i in range(2000))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat_format.format_conversations(df)
    got = {r.conv_id: r for r in made.select("conv_id", "formatted", chat_format.parse_turns(F.col("formatted")).alias("turns"), chat_format.loss_texts(F.col("formatted"), F.col("loss")).alias("loss")).collect()}
    for c in (1, 2, 3, None):
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == c), key=lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or ""))]
        assert [tuple(t) for t in got[c].turns] == want
        assert got[c].loss == [t for role, t in want if role == "assistant"]
    assert got[1].formatted.count("### ") == 2  # adjacent turns of one role share a block
    assert chat_format.format_conversations(df.where("false")).collect() == []


def test_warc_salvage(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i}</p>" * (30 + 100 * (i % 7))) for i in range(60)] + [(90, None, None), (91, "http://b\r\nX: y", ""), (92, "u", "same" * 400), (93, "u", "same" * 400), (None, "u", "same" * 400), (93, "u", "same" * 400)], "page_id long, url string, html string")
    for compress in (True, False):
        folder = f"file://{tmp_path}/w{compress}"
        manifest = warc.write_archives(warc.mark_revisits(pages.coalesce(1)), folder, compress=compress)
        good = warc.read_archives(manifest, range_bytes=3000).collect()
        assert len(good) == 66 and all(r.kind == "record" for r in good)
        assert {(r.page_id, r.record_type, r.refers_to) for r in good if r.page_id in (92, 93, None) and r.target_uri == "u"} == {(92, "revisit", 93), (93, "response", None), (None, "revisit", 93)}
        row = manifest.first()
        data = bytearray(open(row["path"], "rb").read())
        spots = sorted(r.at for r in good)
        hit = spots[10], spots[30]
        for at in hit:
            data[at + 40] ^= 0xFF
        del data[-20:]  # and the last record is cut off
        open(row["path"], "wb").write(data)
        broken = manifest.withColumn("bytes", F.lit(len(data)).cast("long"))
        for size in (2500, 1 << 20):
            found = warc.read_archives(broken, range_bytes=size).collect()
            gaps = sorted((r.at, r.length) for r in found if r.kind == "gap")
            assert sum(r.kind == "record" for r in found) == 63 and [g[0] for g in gaps] == [*hit, spots[-1]], (compress, size)
            assert sum(r.length for r in found) == len(data)
    with gzip.open(tmp_path / "one.gz", "wb") as f:
        f.write(warc.record_bytes(1, "u", b"x", None))
    got, _, recs = warc.parse_member((tmp_path / "one.gz").read_bytes(), 0)
    assert got == "ok" and recs[0]["payload"] == b"x"
    assert warc.read_archives(warc.write_archives(warc.mark_revisits(pages.where("false")), f"file://{tmp_path}/e")).collect() == []


def test_warc_header_of_any_length(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "a" * 2000), (2, "http://a/" + "x" * 100_000, "a" * 2000), (3, "http://b/" + "y" * 5_000_000, "b")], "page_id long, url string, html string")
    for compress in (True, False):
        manifest = warc.write_archives(warc.mark_revisits(pages.coalesce(1)), f"file://{tmp_path}/h{compress}", compress=compress)
        for size in (50_000, 1 << 25):
            got = {r.page_id: (r.kind, r.record_type, r.refers_to, r.target_uri) for r in warc.read_archives(manifest, range_bytes=size).collect()}
            assert got == {p.page_id: ("record", "revisit" if p.page_id == 1 else "response", 2 if p.page_id == 1 else None, p.url) for p in pages.collect()}


def test_url_rules_are_mined(spark):
    bad = [(i, f"http://spam{i % 3}.net/casino/x?buy=1", True) for i in range(60)]
    good = [(100 + i, f"http://site{i % 9}.net/news/{i}", False) for i in range(200)] + [(400, None, False), (401, "nothing", True), (402, "HTTP://A.Org?x", False)]
    pages = spark.createDataFrame(bad + good, "page_id long, url string, bad boolean")
    got = {r.page_id: r for r in url_filter.judge_urls(pages, url_filter.mine_rules(pages), [("site1.net", "/", "block")]).collect()}
    assert all(got[i].verdict == "block" for i in range(60)) and got[100].verdict == "allow" and got[101].rule == "site1.net/" and got[101].verdict == "block"
    assert got[400].host == got[401].path == "" and got[402].host == "a.org" and got[402].path == ""
    none = url_filter.judge_urls(pages, url_filter.mine_rules(pages.where("false")), [])
    assert none.count() == pages.count() and none.where("verdict <> 'allow'").count() == 0
    assert url_filter.judge_urls(pages.where("false"), url_filter.mine_rules(pages), []).collect() == []


def test_recurrent_network_gradients():
    r = np.random.default_rng(0)
    p = {k: v.astype(float) for k, v in byte_gru.start_params(3, 4).items()}
    data, mask, labels = r.integers(0, 256, (6, 5)).astype(np.uint8), np.ones((6, 5)), np.array([0, 1, 2, 1, 0])
    mask[4:, 2] = mask[5, 1] = 0
    _, g = byte_gru.loss_and_grads(p, data, mask, labels)
    for k in p:
        i = (int(data[0, 0]), 1) if k[0] == "X" else tuple(r.integers(0, s) for s in p[k].shape)
        step = [dict(p, **{k: p[k] + np.where(np.indices(p[k].shape).T == i, 1, 0).all(-1).T * e}) for e in (1e-5, -1e-5)]
        a, b = (byte_gru.loss_and_grads(q, data, mask, labels)[0] for q in step)
        assert abs(g[k][i] - (a - b) / 2e-5) < 1e-6


def test_language_on_edge_rows(spark):
    en, de = "the thing and that was here with them ", "und der die nicht schön für über ist "
    rows = [(i, (en, de)[i % 2] * 6, ("en", "de")[i % 2]) for i in range(40)] + [(50, None, "en"), (51, "123 !?", "en"), (52, en * 3000, None), (53, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in lang_id.predict(df, *lang_id.fit(df)).collect()}
    assert got[50] == got[51] == got[53] == ("und", 0.0) and got[52][0] == "en" and got[0][0] == "en" and got[1][0] == "de" and got[0] == got[2]
    assert {r.lang_pred for r in lang_id.predict(df, *lang_id.fit(df.where("lang is null"))).collect()} == {"und"}
    assert lang_id.predict(df.where("false"), *lang_id.fit(df)).collect() == []


@pytest.mark.parametrize("values", [[3, 1], [300, 700, 5]])
def test_prefix_sums(spark, values):
    df = spark.createDataFrame([(list(range(n)),) for n in values], "x array<long>")
    for r in df.select("x", chat_format.starts_of(F.col("x")).alias("s")).collect():
        assert r.s == np.concatenate([[0], np.cumsum(r.x)[:-1]]).tolist()
