"""URL filtering by association rules; DataFrame and Spark ML operations only.

``mine_rules`` runs FP-growth over the URL tokens of labelled pages and keeps the rules
"tokens => bad" of enough support and confidence that no shorter rule makes needless. FP-growth's
itemsets may double with each token of a basket; where one has more than ``MOST_ITEMS``, the same
rules come level by level from sets that no subset makes needless (``free_sets``).
``match_rules`` finds the URLs a rule fits through an inverted index: each rule is filed under its
rarest token, the distinct URLs meet it there, and only then are all of its tokens checked. A fixed
rule list overrides the mined verdict; of fixed rules that fit the longest wins, of equally long
ones that with the longer host, then the one that sorts last.

Defined results: a null url or one without ``://`` has an empty host and path, no token and so the
verdict allow, unless a fixed rule fits; rows with one url are judged alike and all stay; a very long
url is split into all its tokens, and mining takes all that are frequent; without labelled
pages nothing is mined and every verdict is allow; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, salted, stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "y=bad"
MIN_SUPPORT, MIN_PAGES, MIN_CONFIDENCE, MIN_LIFT, Z = 0.002, 5, 0.5, 1.5, 3.0
MOST_ITEMS, MAX_ITEMS = 12, 4  # tokens of a basket that FP-growth takes, items of a rule
PARTS = r"(?s)\A.*?://([^/?#]*)([^?#]*)\??([^#]*)"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def tokens_of(url: Column) -> Column:
    """Distinct tokens: host labels, path segments and query keys; digits become 0."""
    words = lambda kind, text, sep: F.transform(F.filter(F.split(text, sep), lambda x: x != ""), lambda x: F.concat(F.lit(kind), F.regexp_replace(F.lower(x), "[0-9]+", "0")))
    query = F.coalesce(F.regexp_extract(url, PARTS, 3), F.lit(""))
    keys = F.regexp_replace(query, "=[^&]*", "")
    return F.array_distinct(F.concat(words("h=", host_of(url), r"\."), words("p=", path_of(url), "/"), words("q=", keys, "&")))


def lower_bound(hits: Column, n: Column, z: float = Z) -> Column:
    """Wilson's lower bound of the share hits / n."""
    share = hits / n
    return (share + z * z / (2 * n) - z * F.sqrt(share * (1 - share) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def baskets_of(labelled: DataFrame, least: int) -> DataFrame:
    """items, bad: the tokens of each labelled page that ``least`` pages have, sorted. Stored."""
    rows = stored(labelled.select(F.monotonically_increasing_id().alias("rid"), F.coalesce("bad", F.lit(False)).alias("bad"), tokens_of(F.col("url")).alias("tokens")), "url-labelled")
    each = rows.select("rid", "bad", F.explode("tokens").alias("item"))
    known = stored(each.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= least), "url-tokens")
    hot = hot_keys(known, ["item"], "n", known.agg(F.sum("n")).first()[0] or 0)
    kept = salted(each, known.select("item"), ["item"], ["rid"], hot).groupBy("rid", "bad").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return stored(kept.select("items", "bad"), "url-baskets")


def free_sets(baskets: DataFrame, least: int, max_items: int = MAX_ITEMS) -> DataFrame:
    """items, freq, hits: the sets of up to max_items tokens that ``least`` bad baskets have and that no
    subset has as many baskets as. Stored.

    A set in the same baskets as a subset of its own has that subset's confidence, so the subset's rule
    makes it needless; the same holds for all that contain it. Equal baskets are counted once; a level's
    sets in a basket meet those that differ in the last token."""
    rows = stored(baskets.groupBy("items").agg(F.count("*").alias("n"), F.count_if("bad").alias("hits")).withColumn("bid", F.monotonically_increasing_id()), "url-equal")
    found = rows.select("bid", "n", "hits", F.explode("items").alias("item")).select("bid", "n", "hits", F.array("item").alias("items"))
    levels = []
    for k in range(1, max_items + 1):
        level = found.groupBy("items").agg(F.sum("n").alias("freq"), F.sum("hits").alias("hits")).where(F.col("hits") >= least)
        if levels:
            subsets = level.select("*", F.explode(F.transform("items", lambda x: F.array_remove("items", x))).alias("part"))
            subsets = subsets.join(levels[-1].select(F.col("items").alias("part"), F.col("freq").alias("of_part")), "part")
            level = subsets.where("freq < of_part").groupBy("items", "freq", "hits").agg(F.count("*").alias("parts")).where(F.col("parts") == k).drop("parts")
        levels.append(stored(level, "url-level"))
        if k == max_items or levels[-1].isEmpty():
            break
        live = stored(found.join(levels[-1].select("items"), "items"), "url-found")
        side = lambda c, df=live, k=k: df.select("bid", "n", "hits", F.slice("items", 1, k - 1).alias("head"), F.element_at("items", k).alias(c))
        both = side("a").join(side("b").drop("n", "hits"), ["bid", "head"]).where("a < b")
        found = both.select("bid", "n", "hits", F.concat("head", F.array("a", "b")).alias("items"))
    sets = levels[0]
    for level in levels[1:]:
        sets = sets.unionByName(level)
    return sets


def mine_rules(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_pages: int = MIN_PAGES, min_confidence: float = MIN_CONFIDENCE, min_lift: float = MIN_LIFT, max_items: int = MAX_ITEMS, most_items: int = MOST_ITEMS) -> DataFrame:
    """rule_id, items, confidence, lift, first (the rarest item), from rows of url and bad (boolean).

    A rule "all of items => bad" stands if the larger of ``min_pages`` and the ``min_support``-th part
    of the labelled pages have it and are bad, if its confidence and lift suffice, if the lower bound
    of its confidence is above the share of bad pages, and if no rule of fewer of its items is as
    confident. FP-growth mines them as long as no basket has more than ``most_items`` tokens, so that its
    itemsets are bounded; else ``free_sets`` does, with the same rules."""
    spark = labelled.sparkSession
    total = labelled.count()
    least = max(min_pages, math.ceil(min_support * total))
    kind = "rule_id long, items array<string>, confidence double, lift double, first string"
    baskets = baskets_of(labelled, least)
    if baskets.isEmpty():
        return spark.createDataFrame([], kind)
    n, n_bad = labelled.agg(F.count("*"), F.count_if("bad")).first()
    if baskets.agg(F.max(F.size("items"))).first()[0] > most_items:
        rules = free_sets(baskets, least, max_items)
        single = rules.where("size(items) = 1").select(F.col("items")[0].alias("item"), "freq")
    else:
        marked = baskets.select(F.when(F.col("bad"), F.array_append("items", F.lit(BAD))).otherwise(F.col("items")).alias("items"))
        model = FPGrowth(itemsCol="items", minSupport=(least - 0.5) / baskets.count(), minConfidence=0.0).fit(marked)
        sets = stored(model.freqItemsets.where(F.size("items") <= max_items + 1).select(F.sort_array("items").alias("items"), "freq"), "url-itemsets")
        with_bad = sets.where(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("items"), F.col("freq").alias("hits"))
        rules = with_bad.join(sets, "items").select("items", "freq", "hits")
        single = sets.where("size(items) = 1").select(F.col("items")[0].alias("item"), "freq")
    rules = rules.select("items", "freq", (F.col("hits") / F.col("freq")).alias("confidence"), lower_bound(F.col("hits"), F.col("freq")).alias("low"))
    base = n_bad / n
    rules = rules.where((F.col("confidence") >= min_confidence) & (F.col("confidence") >= min_lift * base) & (F.col("low") > base))
    rules = stored(rules.select("items", "confidence", (F.col("confidence") / F.lit(base or 1.0)).alias("lift")), "url-rules").withColumn("rule_id", F.xxhash64("items"))
    bits = F.sequence(F.lit(1), (F.pow(F.lit(2), F.size("items")) - 2).cast("int"))
    parts = rules.where("size(items) > 1").select("rule_id", "confidence", "items", F.explode(bits).alias("mask"))
    parts = parts.select("rule_id", "confidence", F.filter("items", lambda _, i: F.expr("mask").bitwiseAND(F.call_function("shiftleft", F.lit(1), i)) > 0).alias("part"))
    covered = parts.join(rules.select(F.col("items").alias("part"), F.col("confidence").alias("of_part")), "part").where("of_part >= confidence").select("rule_id").distinct()
    rules = rules.join(covered, "rule_id", "left_anti")
    rare = rules.select("rule_id", F.explode("items").alias("item")).join(single, "item").groupBy("rule_id").agg(F.min(F.struct("freq", "item")).alias("rare"))
    return stored(rules.join(rare, "rule_id").select("rule_id", "items", "confidence", "lift", F.col("rare.item").alias("first")), "url-rule-index")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """url, n, confidence: the distinct urls, how many rows have each, and the best confidence of the
    mined rules that fit (null without one). Stored."""
    tokens = stored(urls.where("url is not null").groupBy("url").agg(F.count("*").alias("n")).withColumn("tokens", tokens_of(F.col("url"))), "url-distinct")
    each = tokens.select("url", "tokens", F.explode("tokens").alias("first"))
    index = rules.groupBy("first").agg(F.collect_list(F.struct("items", "confidence")).alias("rules"))
    index = stored(each.groupBy("first").agg(F.count("*").alias("urls")).join(index, "first"), "url-rule-places")
    hot = hot_keys(index, ["first"], "urls", index.agg(F.sum("urls")).first()[0] or 0)
    meets = salted(each, index.drop("urls"), ["first"], ["url"], hot)
    fits = meets.select("url", F.array_max(F.transform(F.filter("rules", lambda r: F.size(F.array_except(r["items"], F.col("tokens"))) == 0), lambda r: r["confidence"])).alias("confidence"))
    best = fits.groupBy("url").agg(F.max("confidence").alias("confidence"))
    return stored(tokens.select("url", "n").join(best, "url", "left"), "url-judged")


def fixed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest fitting rule of a short list of (host, path, verdict) as text, and its verdict."""
    rule = verdict = F.lit(None).cast("string")
    for h, p, what in sorted(rules, key=lambda r: (len(r[0] + r[1]), len(r[0]), r)):  # shortest first: later ones wrap it
        fits = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return rule, verdict


def judge_urls(pages: DataFrame, rules: DataFrame, fixed: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict, mined (the method's own verdict)."""
    hits = match_rules(pages, rules)
    hot = hot_keys(hits, ["url"], "n", hits.agg(F.sum("n")).first()[0] or 0)
    df = salted(pages.select("page_id", "url"), hits.drop("n"), ["url"], ["page_id"], hot, "left")
    df = df.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.when(F.col("confidence").isNotNull(), F.lit("block")).otherwise(F.lit("allow")).alias("mined"))
    rule, verdict = fixed_rule(F.col("host"), F.col("path"), fixed)
    return df.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.col("mined")).alias("verdict"), "mined")
