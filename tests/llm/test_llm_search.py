"""License scan, collocations and lexical search on edge rows, against brute force."""

import collections
import math
import random
import re

import pytest

from somaspark.llm import collocations, lexical_search, license_scan

DOCS = "doc_id long, text string, lang string, row string, term string, n long, words string, block int, w1 string"
A_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def make(spark, rows):
    return spark.createDataFrame([(i, t, lang, "r", "t", 7, "w", 3, "x") for i, t, lang in rows], DOCS)


def prose(seed, n, vocabulary=60):
    r = random.Random(seed)
    return "".join(r.choice(["the ", "of ", "Of\t", "the. ", "É", "a;b\n"]) if r.random() < 0.3 else f"w{int(vocabulary * r.random() ** 3)} " for _ in range(n))


# ---- license scan

LINES = [
    "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under CC BY-NC 4.0. cc by cc by", "All rights reserved. Copyright (c) 2020 Foo Bar. All Rights Reserved", "Licensed under the Apache License, Version 2.0 (the License)",
    "This work is licensed under the GNU General Public License, version 3.", "released under the MIT License", "no licence here", "mité License", "Tous droits réservés", "BSD-3-Clause or BSD", "cc by sa",
]


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_Z))
    base = [(label, i) for phrase, label in license_scan.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    found = []
    for n, r in enumerate(license_scan.rules()):  # no gate, every rule on every text
        for m in re.finditer(license_scan.spaced(r.pattern), " " + "  ".join(words) + " "):
            a = m.string[: m.start()].count(" ") // 2
            found.append((r.level, n, a, a + m[0].count(" ") // 2 - 1, r.label))

    def beats(o, d):
        return o[2] <= d[2] and o[3] >= d[3] and (o[0], o[3] - o[2], -o[1]) > (d[0], d[3] - d[2], -d[1])

    stay = [d for d in found if not any(beats(o, d) for o in found)]
    return len(words), sorted(base), sorted((d[2], d[3], d[4], d[0]) for d in stay)


def test_license_scan_against_all_rules_on_all_texts(spark):
    r = random.Random(1)
    texts = [None, "", " \n", *LINES, *[" ".join(r.choices([*LINES, *prose(2, 40).split()], k=30)) for _ in range(40)]]
    for rule in license_scan.rules():  # the words of every rule, so that each is near a match
        texts.append(re.sub(r"\[\^ \]\+", "word", re.sub(r"\{\d+,\d+\}|\?", "", re.sub(r"\[([^\]^])[^\]]*\]", r"\1", rule.pattern))).replace("(", "").replace(")", "").replace("|", " "))
    df = make(spark, [(i, t, "en") for i, t in enumerate(texts)] + [(5, texts[5], "en"), (None, LINES[0], None)])
    got = license_scan.license_scan(df).collect()
    assert len(got) == len(texts) + 2
    for x in got:
        base = sorted((b.label, b.word) for b in x.base)
        assert (x.n_words, base, sorted((f.first, f.last, f.label, f.level) for f in x.found)) == plain_scan(x.row.text)
    labels = {x.row.doc_id: {f.label for f in x.found} for x in got}
    at = texts.index
    assert labels[at(LINES[0])] == {"gpl-3.0"} and labels[at(LINES[1])] == {"cc-by-nc-4.0", "cc-by"} and labels[at(LINES[3])] == {"apache-2.0"} and labels[at(LINES[6])] == set() == labels[at(LINES[7])]
    assert license_scan.license_scan(make(spark, [])).collect() == []


def test_every_rule_needs_its_keyword_and_can_match():
    for r in license_scan.rules():
        pattern = license_scan.spaced(r.pattern)
        words = re.sub(r"\[\^ \]\+", "word", re.sub(r"\([^()]*\)\{[^}]*\}", " word", re.sub(r"\([^()]*\)\?", "", r.pattern)))
        words = re.sub(r"\[([^\]^])[^\]]*\]", r"\1", re.sub(r"\(([^()|]*)[^()]*\)", r"\1", words)).replace("?", "")
        assert re.search(pattern, " " + "  ".join(words.split()) + " "), r
        without = "  ".join(w for w in words.split() if w != r.keyword)
        assert r.keyword in words.split() and not re.search(pattern, f" {without} "), r


def test_license_scan_of_a_very_long_text_with_many_detections(spark):
    text = "cc by all rights reserved apache license version 2.0 x " * 20_000
    (x,) = license_scan.license_scan(make(spark, [(1, text, "en")])).collect()
    assert x.n_words == 11 * 20_000 and len(x.base) == 40_000 and collections.Counter(f.label for f in x.found) == {"cc-by": 20_000, "reserved": 20_000, "apache-2.0": 20_000}


# ---- collocations


def plain_collocations(docs, least, percent, top):
    f, n = collections.defaultdict(collections.Counter), collections.Counter()
    for _, text, lang in docs:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(A_Z)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                f[lang or "und"].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        long = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        worst = collections.Counter()
        for p, a in long.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    worst[p[i : i + m]] = max(worst[p[i : i + m]], a)
        rows = []
        for p, a in long.items():
            if 100 * worst[p] < percent * a:
                score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("parts, size", [(1024, 1 << 19), (4, 50), (50, 7)])
def test_collocations(spark, parts, size):
    docs = [(i, prose(i, 200), random.Random(i).choice(["en", "fr", None])) for i in range(40)]
    docs += [(90, None, "en"), (91, "", "en"), (92, ". , ;", "de"), (93, "one", "it"), (94, "a b c d e " * 60, "en"), (94, "a b c d e " * 60, "en"), (95, "x\x00y z\x01 \xa0 " * 40, "de"), (96, "\U0001f600 é " * 40, "de")]
    df = make(spark, docs)
    got = collocations.collocations(df.repartition(3), min_count=5, top=60, parts=parts, size=size).collect()
    assert sorted(map(tuple, got)) == plain_collocations(docs, 5, 80, 60)
    assert collocations.collocations(make(spark, [])).collect() == []


def test_collocations_of_a_very_long_text_run_over_the_cuts(spark, monkeypatch):
    docs = [(1, "the quick brown fox " * 3000 + "y" * 300_000 + " the quick", "en")]
    got = collocations.collocations(make(spark, docs), size=100).collect()
    assert sorted(map(tuple, got)) == plain_collocations(docs, 30, 80, 2000)


def test_hot_prefixes_are_found_and_dealt_apart(spark):
    docs = make(spark, [(i, f"of the end of the {'day' if i % 2 else 'line'}", "en") for i in range(100)])
    found, totals, often = collocations.survey(docs, 30, parts=8, size=60)
    assert totals == {"en": 600}
    heavy = {tuple(x for x in r if x is not None) for r in found.select("lang", "w1", "w2", "w3").collect()}
    assert {("en", "of"), ("en", "of", "the"), ("en", "the", "end")} <= heavy and ("en", "of", "the", "day") not in heavy
    for able in (None, often):
        rows = collocations.suffixes(docs, heavy, able, 60).where("w1 = 'of'").collect()
        assert len({r.deal for r in rows}) > 1 and {r.depth for r in rows} <= {2, 3, 4} and sum(r.n for r in rows) == 200


def test_suffixes_are_cut_before_what_cannot_be_frequent(spark, monkeypatch):
    monkeypatch.setattr(collocations, "FAN", 2)
    docs = make(spark, [(i, f"often seen here x{i} once{i} often seen", "en") for i in range(40)])
    _, _, often = collocations.survey(docs.repartition(5), 30)
    assert [int(x.sum()) for x in often] == [3, 2, 1]  # often, seen, here; often seen, seen here; often seen here
    rows = {tuple(r)[1:6] for r in collocations.suffixes(docs.coalesce(1), set(), often).collect() if r.w1 in ("often", "seen", "here")}
    assert rows == {("often", "seen", "here", None, 40), ("often", "seen", None, None, 40), ("seen", "here", None, None, 40), ("seen", None, None, None, 40), ("here", None, None, None, 40)}


def test_suffixes_of_a_first_word_travel_as_one_row(spark):
    docs = make(spark, [(i, f"often seen here x{i} once{i} often seen {prose(i, 30)}", "en") for i in range(40)]).coalesce(1)
    heavy = {("en", "often")}
    rows = collocations.suffixes(docs, heavy, None, 100).collect()
    lists = collocations.tails(docs, heavy, None, 100).collect()
    got = [(r.lang, r.w1, r.depth, r.deal, *x.split(" "), n) for r in lists for x, n in zip(r.tails.split("\n"), r.n, strict=True)]
    want = [(r.lang, r.w1, r.depth, r.deal, *([w for w in (r.w2, r.w3, r.w4) if w is not None] or [""]), r.n) for r in rows]
    assert collections.Counter(got) == collections.Counter(want) and len(lists) < len(rows)


def test_suffixes_of_a_task_are_folded_over_its_blocks(spark, monkeypatch):
    docs = make(spark, [(i, f"of the w{i % 100} or the end", "en") for i in range(400)]).coalesce(1)
    want = collections.Counter()
    for r in collocations.suffixes(docs, set(), None, 10_000).collect():
        want[r.w1, r.w2, r.w3, r.w4] += r.n
    for heavy in (set(), {("en", "of"), ("en", "of", "the")}):
        rows = collocations.suffixes(docs, heavy, None, 20).collect()
        assert len(rows) == len(want) and {(r.w1, r.w2, r.w3, r.w4): r.n for r in rows} == want
        lists = collocations.tails(docs, heavy, None, 20).collect()
        firsts = collections.Counter(r.w1 for r in lists)
        assert set(firsts) == {w[0] for w in want} and all(n == 1 or heavy and w == "of" for w, n in firsts.items())
        assert len(lists) == len({(r.lang, r.w1, r.depth, r.deal) for r in lists}) and 0 < firsts["of"] <= 2**collocations.DEAL_BITS
        assert bool(heavy) == (firsts["of"] > 1)
    monkeypatch.setattr(collocations, "KEPT", 50)  # given away when full, nothing is lost
    got = collections.Counter()
    for r in collocations.suffixes(docs, set(), None, 20).collect():
        got[r.w1, r.w2, r.w3, r.w4] += r.n
    assert got == want


def test_first_words_with_more_suffixes_than_are_held_are_counted_in_parts(spark):
    rows = [("en", "a", 1, 0, "b c\nb", [2, 1])] * 30 + [("en", "a", 1, 5, "b d", [4])] + [("en", "z", 1, 0, "\nb", [3, 9])] * 2
    lists = spark.createDataFrame(rows, "lang string, w1 string, depth int, deal int, tails string, n array<int>").coalesce(1)
    for held in (1, 4, 1000):
        got = collocations.prefix_counts(lists, 10, held).collect()
        sums = collections.Counter()
        for r in got:
            sums[tuple(w for w in (r.w1, r.w2, r.w3) if w)] += r.n
        assert {k: v for k, v in sums.items() if v >= 10} == {("a",): 94, ("a", "b"): 94, ("a", "b", "c"): 60, ("z",): 24, ("z", "b"): 18}


# ---- lexical search


def plain_search(docs, items, k):
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(A_Z))
    known = [(i, collections.Counter(terms(t))) for i, t, _ in docs if i is not None and terms(t)]
    n_docs, total = len(known), sum(c.total() for _, c in known)
    df = collections.Counter(t for _, c in known for t in c)
    out = []
    for item in {i for i, _ in items if i is not None}:
        asked = {t for i, text in items if i == item for t in terms(text)} & set(df)
        rows = []
        for i, c in known:
            m = 50 + 50 * c.total() * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in asked if t in c)
            if s > 0:
                rows.append((-s, i))
        out += [(item, rank, i, -s) for rank, (s, i) in enumerate(sorted(rows)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("block, k", [(4096, 50), (16, 7), (3, 50)])
def test_search(spark, monkeypatch, block, k):
    docs = [(i, prose(i, random.Random(i).randrange(1, 120)), "en") for i in range(150)]
    docs += [(i, "same words here of the w1", "en") for i in range(300, 340)]  # ties
    docs += [(200, None, "en"), (201, "", "en"), (202, " .;", "en"), (203, "É é Été w1 w2", "en"), (None, "w1 w2 w3", "en"), (300, "same words here of the w1", "en"), (204, "w1 " * 30_000, "en")]
    items = [(1, "W1 w2 w2 the"), (2, None), (3, "nothing known"), (4, "same words HERE"), (5, prose(7, 80)), (1, "more w9"), (None, "w1"), (6, "été É of")]
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", block)
    monkeypatch.setattr(lexical_search, "FIRST", 3)
    monkeypatch.setattr(lexical_search, "STEP", 4)
    monkeypatch.setattr(lexical_search, "CHUNK", 3)
    df = make(spark, docs).repartition(2)
    asked = spark.createDataFrame([(i, t, "x", 9) for i, t in items], "item_id long, text string, doc_id string, block int")
    got = lexical_search.search(df, asked, k).collect()
    assert sorted(map(tuple, got)) == plain_search(docs, items, k)


def test_search_of_empty_tables(spark):
    asked = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical_search.search(make(spark, []), asked).collect() == []
    assert lexical_search.search(make(spark, [(1, "w1", "en")]), asked.where("item_id = 2")).collect() == []


def test_treaps_prune(monkeypatch):
    """A range whose bound cannot reach the k-th score is not split: few documents are scored."""
    import numpy as np
    import pyarrow as pa

    r = np.random.default_rng(2)
    rows, s = {c: [] for c in ("term", "docs", "ids", "impacts", "left", "right", "root")}, 0
    for t in range(3):
        d = np.sort(r.choice(20_000, 8_000, replace=False))
        imp = (r.pareto(1.0, len(d)) * 1000).astype(np.int64)
        left, right, root = lexical_search.treap(((imp << 32) | r.permutation(len(d))).tolist())
        for c, x in zip(rows, (f"t{t}", d.tolist(), d.tolist(), imp.tolist(), left, right, root), strict=True):
            rows[c].append(x)
    kinds = [pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32()]
    treaps = lexical_search.Treaps(pa.table([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], list(rows)))
    scored = []
    inside = treaps.inside
    monkeypatch.setattr(treaps, "inside", lambda node, lo, hi: scored.append(len(node) // 2) or inside(node, lo, hi))
    w = np.array([3, 2, 5])
    ids, scores = treaps.best(np.arange(3), w, 10, 1)
    whole = np.zeros(20_000, np.int64)
    for t in range(3):
        whole[rows["docs"][t]] += w[t] * np.array(rows["impacts"][t])
    order = np.lexsort((np.arange(20_000), -whole))[:10]
    assert ids.tolist() == order.tolist() and scores.tolist() == whole[order].tolist() and sum(scored) < 3_000
