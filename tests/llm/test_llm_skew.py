"""Hot keys, repeated rows, very long texts and bounds of what the driver gets."""

import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from somaspark.llm import byte_gru, components, lang_id, line_dedup, media, packing, quality_rules, sentence_pieces, setsketch, url_filter
from somaspark.llm.common import HOT_PARTS, hot_keys, salted


def test_hot_keys_are_dealt_and_bounded(spark):
    n = 20_000
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    hot = hot_keys(df.groupBy("k").count(), ["k"], "count", n)
    assert [tuple(r) for r in hot.collect()] == [(-1, -(-6667 // (n // HOT_PARTS)))]
    groups = df.select("k").distinct().withColumn("name", F.concat(F.lit("g"), "k"))
    got = salted(df, groups, ["k"], ["id"], hot)
    assert got.count() == n and got.where("name <> 'g' || k").count() == 0 and got.select("id").distinct().count() == n
    lone = salted(df, groups.where("k = -1"), ["k"], ["id"], hot, "left")
    assert lone.count() == n and lone.where("name is not null").count() == 6667


def test_samples_of_repeated_rows_are_bounded(spark):
    one = spark.range(5000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("the same thing "), (F.col("id") % 3).cast("string")).alias("text"), F.lit("en").alias("lang"))
    rest = spark.range(100, 150).select(F.col("id").alias("doc_id"), F.concat(F.lit("eine Sache "), "id").alias("text"), F.lit("de").alias("lang"))
    docs = one.union(rest)
    got = lang_id.sampled(docs).groupBy("lang").count().collect()
    assert {r.lang: r["count"] for r in got}["en"] == 1 and {r.lang: r["count"] for r in got}["de"] <= 50
    assert lang_id.sampled(docs, docs_per_lang=4).count() <= 8
    many = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), (F.col("id") % 300).cast("string").alias("lang"))
    assert lang_id.sampled(many, docs_per_lang=2, most_langs=10).count() <= 20
    assert 30 < media.dictionary_texts(docs).count() <= 51
    assert media.dictionary_texts(many).count() <= media.DICT_ROWS


def test_text_probabilities_against_one_text_at_a_time():
    r = np.random.default_rng(5)
    p = byte_gru.start_params(4, 3)
    texts = [bytes(r.integers(0, 256, n).astype(np.uint8)) for n in (0, 1, 5, 95, 96, 97, 400, 3, 1000)]
    sizes = np.array([len(t) for t in texts])
    got = lang_id.text_probs(p, np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes)
    for t, row in zip(texts, got, strict=True):
        total = np.zeros(len(p["c"]))
        for at in range(0, len(t), lang_id.LENGTH):
            part = np.frombuffer(t[at : at + lang_id.LENGTH], np.uint8)[:, None]
            total += byte_gru.position_probs(p, part, np.ones(part.shape, np.float32))[:, 0]
        assert np.allclose(row, total / max(1, len(t)), atol=1e-5)


def test_features_and_cuts_in_blocks(monkeypatch):
    r = np.random.default_rng(6)
    for n in (1, 2, 3, 192, 5000):
        x = r.integers(60, 70, n).astype(np.uint8)
        v = x.astype(int)
        turns = int((np.diff(np.sign(np.diff(v))) != 0).sum())
        want = f"mean={v.sum() * 1000 // n};power={(v * v).sum() // n};peak={v.max()};turns={turns};distinct={len(np.unique(v))}"
        whole = media.gear_cuts(x)
        for block in (1 << 18, 64, 33):
            monkeypatch.setattr(media, "BLOCK", block)
            assert media.feature(x) == want and (media.gear_cuts(x) == whole).all()
        monkeypatch.setattr(media, "BLOCK", 1 << 18)


def test_words_longer_than_the_table_of_powers():
    a, b = "a" * 65_536, "b" * 65_536
    hashes = {int(setsketch.word_hashes(x.encode())[0]) for x in (a + b, b + a, a + a, a, a + b + a, b + a + a)}
    assert len(hashes) == 6
    assert setsketch.word_hashes(f"{a}{b} {a}{b}".encode())[0] == setsketch.word_hashes(f"x {a}{b}".encode())[1]


def test_contraction_of_blocks(spark, monkeypatch):
    monkeypatch.setattr(components, "BLOCK", 64)
    r = random.Random(3)
    edges = [(f"n{r.randrange(900)}", f"n{r.randrange(900)}") for _ in range(600)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        root[find(a)] = find(b)
    labels = {x.node: x.label for x in components.labels_of(spark.createDataFrame(edges, "a string, b string")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    assert set(labels) == nodes
    assert len({(labels[x], find(x)) for x in nodes}) == len({find(x) for x in nodes}) == len(set(labels.values()))


def test_long_units_are_searched_in_bounded_groups(spark):
    texts = ["\u4e2d\u6587" * 30_000, "QUJD" * 40_000, "x" * 100_000 + " end", "short one"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(1)
    got = {r.doc_id: r.decoded for r in sentence_pieces.decode(sentence_pieces.encode(df)).collect()}
    assert got == dict(enumerate(texts))


def test_many_removed_lines_of_one_text(spark):
    n = 100_000
    long = "\n".join(["boiler", "own"] * (n // 2) + ["last"])
    rows = [(0, "boiler\nfirst", "s0")] + [(i, "boiler", f"s{i}") for i in range(1, 8)] + [(9, long, "s9")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.row.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert got[0].n_removed == 0 and got[9].n_removed == n // 2 and got[9].n_lines == n + 1
    assert got[9].text == "\n".join(["own"] * (n // 2) + ["last"])


def test_one_length_for_all(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 100)
    tokens = spark.range(3000).select(F.col("id").alias("rid"), F.lit(10).cast("long").alias("n")).union(spark.range(3000, 3010).select("id", F.lit(9000).cast("long")))
    cuts = packing.cut_places(tokens, 4096).collect()
    assert sum(c.length for c in cuts) == 3000 * 10 + 10 * 9000
    cells = {(c.sequence_id, c.offset + k) for c in cuts for k in range(c.length)}
    assert len(cells) == 3000 * 10 + 10 * 9000 and max(c.offset + c.length for c in cuts) <= 4096


def test_limits_follow_the_rates_of_a_source(spark):
    def docs(rate, source, start):
        return [(start + i, " ".join(f"w{i}x{k}" + ("#" if k < rate * (i % 10) else "") for k in range(60)), "en", source) for i in range(100)]

    def limit(rate):
        m = quality_rules.measured(spark.createDataFrame(docs(1, "a", 0) + docs(rate, "b", 1000), "doc_id long, text string, lang string, source string"))
        lim = quality_rules.fences(quality_rules.limits(m)).where("source_key is not null")
        return {r.source_key: r.symbol_rate_high for r in lim.collect()}

    one, two = limit(1), limit(2)
    assert one["=a"] == one["=b"] == two["=a"] and abs(two["=b"] - 2 * one["=b"]) < 1e-9 and one["=a"] > 0
    bare = spark.createDataFrame([(1, "a b")], "doc_id long, text string")  # no lang, no source
    assert quality_rules.quality_filter(bare).collect() == []


def brute_rules(pages, least, confidence, lift, most):
    """All combinations of tokens that the pages have."""
    n, bad = len(pages), sum(b for _, b in pages)
    seen = {}
    for tokens, b in pages:
        for k in range(1, most + 1):
            for c in itertools.combinations(sorted(tokens), k):
                x = seen.setdefault(c, [0, 0])
                x[0] += 1
                x[1] += b

    def low(h, m, z=url_filter.Z):
        s = h / m
        return (s + z * z / (2 * m) - z * (s * (1 - s) / m + z * z / (4 * m * m)) ** 0.5) / (1 + z * z / m)

    ok = {c: h / m for c, (m, h) in seen.items() if h >= least and h / m >= confidence and h / m >= lift * bad / n and low(h, m) > bad / n}
    return {c: x for c, x in ok.items() if not any(d in ok and ok[d] >= x for k in range(1, len(c)) for d in itertools.combinations(c, k))}


def test_mined_rules_against_brute_force(spark):
    r = random.Random(10)
    names = ["ant", "bee", "cat", "dog", "eel", "fox", "gnu"]
    rows = []
    for i in range(600):
        tokens = [t for t in names if r.random() < 0.4]
        bad = r.random() < (0.95 if {"bee", "eel"} <= set(tokens) else 0.8 if {"cat", "dog", "fox"} <= set(tokens) else 0.1)
        rows.append((i, "x://host/" + "/".join(tokens) + "?" + "&".join(f"{t}=1" for t in tokens[:1]), bad))
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    mined = url_filter.mine_rules(pages)
    got = {tuple(x["items"]): x.confidence for x in mined.collect()}
    plain = [({"h=host"} | {f"p={t}" for t in u.split("?")[0].split("/")[3:] if t} | {f"q={t.split('=')[0]}" for t in u.split("?")[1].split("&") if t}, b) for _, u, b in rows]
    want = brute_rules(plain, url_filter.MIN_PAGES, url_filter.MIN_CONFIDENCE, url_filter.MIN_LIFT, url_filter.MAX_ITEMS)
    assert len(want) >= 2 and ("p=bee", "p=eel") in want
    assert {c: round(x, 9) for c, x in got.items()} == {c: round(x, 9) for c, x in want.items()}
    verdict = {x.page_id: x.mined for x in url_filter.judge_urls(pages.withColumn("n", F.lit(3)).withColumn("salt", F.lit(3)), mined, []).collect()}
    for (i, _, _), (tokens, _) in zip(rows, plain, strict=True):
        assert verdict[i] == ("block" if any(set(c) <= tokens for c in want) else "allow")


def test_urls_of_any_length(spark):
    long = "http://host.net/" + "/".join(f"seg{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(20_000))
    pages = spark.createDataFrame([(i, long, i % 2 == 0) for i in range(20)], "page_id long, url string, bad boolean")
    got = url_filter.judge_urls(pages, url_filter.mine_rules(pages), []).collect()
    assert len(got) == 20 and {r.host for r in got} == {"host.net"} and {r.mined for r in got} == {"allow"}
