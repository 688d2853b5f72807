"""op9's fixed rules, word by word, and mining without a cap on a page's tokens."""

import random

from somaspark.llm import q_url, url_filter


def test_fixed_rules_are_the_contracts(spark, tmp_path):
    wanted = "allow org/, block example.org/es/, block example.org/en/1, allow com/fr/, block com/de/"
    assert ", ".join(f"{what} {host}{path}" for host, path, what in q_url.RULES) == wanted
    urls = {
        1: ("http://example.org/en/12", "example.org/en/1", "block"), 2: ("http://a.example.org/en/1?q", "example.org/en/1", "block"), 3: ("http://example.org/en/2", "org/", "allow"),
        4: ("http://Example.ORG/es/", "example.org/es/", "block"), 5: ("http://notexample.org/es/", "org/", "allow"), 6: ("x://b.com/fr/1", "com/fr/", "allow"),
        7: ("x://b.com/de/1#c", "com/de/", "block"), 8: ("x://b.com/en/1", None, "allow"), 9: (None, None, "allow"), 10: ("example.org/es/", None, "allow"),
    }
    spark.createDataFrame([(i, u) for i, (u, _, _) in urls.items()], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.page_id: (r.rule, r.verdict) for r in q_url.op9_url_filter(spark, str(tmp_path)).collect()}
    assert got == {i: (rule, verdict) for i, (_, rule, verdict) in urls.items()}


def test_rules_of_pages_with_many_tokens(spark):
    """20 noise tokens that are bad more often than the pair that makes a rule: a basket of the 12 most often bad lost it."""
    r, rows = random.Random(4), []
    for i in range(400):
        pair = [t for t in ("left", "right") if r.random() < 0.5]
        bad = len(pair) == 2 and r.random() < 0.95
        noise = [f"n{chr(97 + k)}" for k in range(20) if r.random() < (0.9 if bad else 0.3)]
        rows.append((i, "x://host/" + "/".join(pair + noise), bad))
    pages = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    got = {tuple(x["items"]): x.confidence for x in url_filter.mine_rules(pages, max_items=2).collect()}
    both = [b for _, u, b in rows if "/left" in u and "/right" in u]
    assert abs(got["p=left", "p=right"] - sum(both) / len(both)) < 1e-9
    few = spark.createDataFrame([(i, "/".join(u.split("/")[:8]), b) for i, u, b in rows], pages.schema)
    rules = lambda **k: {(tuple(x["items"]), round(x.confidence, 9), x["first"]) for x in url_filter.mine_rules(few, **k).collect()}
    assert len(rules()) > 1 and rules() == rules(most_items=0)
