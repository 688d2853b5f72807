"""Predictions back to alleles (N4, N5, B7), as column expressions over each candidate's own columns.

A row holds one prediction and its tensor's first two planes, a list a column: ``refs`` and ``alts``
(array of columns, each the counts of - A C G T). A *base* column has a base as its most frequent
reference entry, a *gap* column an insertion; columns without counts are neither.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("DEL", "INS", "NONE", "SNP")


def best_index(x: Column) -> Column:
    """0-based place of the largest value, the first of equals."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def letter(x: Column) -> Column:
    """The base of the largest of four counts."""
    return F.substr(F.lit("ACGT"), best_index(x) + 1, F.lit(1))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def tried(at: dict[str, Column], centre: Column, types: Column, min_p: float, far: float) -> Column:
    """The first type, from the likeliest on, that ends the search: struct(kind, at), at null for no call.

    It ends at NONE, at a type without a column to stand in, when less than min_p is left, or at a type
    within ``far`` of the candidate's centre; types farther away are passed over."""
    one = [F.struct((-F.get(types, F.lit(k))).alias("loss"), F.lit(k).alias("k"), F.lit(kind).alias("kind"), at[kind].alias("at")) for k, kind in enumerate(KINDS)]
    order = F.array_sort(F.array(*one))
    left = lambda i: -F.aggregate(F.slice(order, i + 1, F.lit(len(KINDS))), F.lit(0.0), lambda a, t: a + t["loss"])
    refused = lambda t, i: (left(i) < min_p) | (t["kind"] == "NONE") | t["at"].isNull()
    judged = F.transform(order, lambda t, i: F.struct(t["kind"].alias("kind"), F.when(~refused(t, i), t["at"]).alias("at"), (refused(t, i) | (F.abs(t["at"] - centre) <= far)).alias("ends")))
    return F.get(F.filter(judged, lambda t: t["ends"]), F.lit(0))


def alleles(df: DataFrame, min_p: float = 0.05, near: float = 0.8, far: float = 3.0, room: int = 7) -> DataFrame:
    """The called record of each prediction: id, pos, ref, alt, prob; predictions without one give no row.

    Rows: id, pos, ref, alt (the candidate), centre int (its column), place double, types array<double>
    (DEL INS NONE SNP), lens array<double> (4), refs and alts, and the reference around it: around
    string, around_pos int (1-based place of its first base). A centre within ``near`` of the
    candidate's is the candidate's. A record whose reference bases differ from ``around`` or reach
    beyond it is left out, as is one that changes nothing. Null or empty columns give no row."""
    c = F.col
    tail = lambda x: F.slice(x, 2, 4)
    column = lambda r, i: F.struct(
        i.alias("i"), ((total(r) > 0) & (best_index(r) > 0)).alias("base"), ((total(r) > 0) & (best_index(r) == 0)).alias("gap"), letter(tail(r)).alias("rb"), letter(tail(F.get(c("alts"), i))).alias("ab"),
        letter(F.transform(tail(F.get(c("alts"), i)), lambda v, k: F.when(k == best_index(tail(r)), 0.0).otherwise(v))).alias("other"), (total(tail(F.get(c("alts"), i))) > 0).alias("seen"))
    df = df.where((F.size("refs") > 0) & (F.size("refs") == F.size("alts"))).withColumn("cols", F.transform("refs", column))
    where = lambda flag: F.transform(F.filter("cols", lambda x: x[flag]), lambda x: x["i"])
    df = df.withColumns({"bases": where("base"), "gaps": where("gap"), "width": F.size("cols"), "want": best_index(c("lens"))})
    df = df.withColumn("spot", F.least(F.greatest("place", F.lit(0.0)), c("width") - 1.0))
    df = df.withColumn("mid", F.when(F.abs(c("spot") - c("centre")) < near, c("centre")).otherwise(F.rint("spot").cast("int")))
    # where a type stands: in a base column, or in a gap for insertions; null: nowhere
    nearest = lambda x: F.array_min(F.transform(x, lambda i: F.struct(F.abs(i - c("spot")).alias("d"), i.alias("i"))))["i"]
    own = lambda x: F.when(F.array_contains(x, c("centre")), c("centre")).otherwise(nearest(c(x)))
    crowded = F.array_contains("bases", c("mid")) & (F.size("gaps") == 0)
    on_base = F.when(F.array_contains("gaps", c("mid")), own("bases")).otherwise(c("mid"))
    in_gap = F.when(crowded, F.when(F.length("alt") >= F.length("ref") + room, c("centre"))).when(F.array_contains("bases", c("mid")), own("gaps")).otherwise(c("mid"))
    df = df.withColumns({"on_base": on_base, "in_gap": in_gap, "as_is": crowded})
    df = df.withColumn("call", tried({k: c("in_gap") if k == "INS" else c("on_base") for k in KINDS}, c("centre"), c("types"), min_p, far))
    df = df.withColumns({"kind": c("call.kind"), "at": c("call.at"), "grown": F.length("alt") - F.length("ref")})
    # columns to positions: the candidate's own column is known
    anchor = c("centre") - F.when(c("grown") > 0, 1).otherwise(0)
    rank = lambda i: F.size(F.filter("bases", lambda b: b < i))
    df = df.withColumn("first_pos", c("pos") + F.when(c("grown") < 0, 1).otherwise(0) - rank(anchor))
    place = lambda i: c("first_pos") + rank(i)
    text = lambda cols, f: F.array_join(F.transform(cols, lambda x: x[f]), "")
    at_cols = lambda idx: F.transform(idx, lambda i: F.get(c("cols"), i))
    size = F.when(c("want") == 3, F.greatest(F.abs(F.when(c("kind") == "INS", F.greatest("grown", F.lit(0))).otherwise(F.least("grown", F.lit(0)))), F.lit(3))).otherwise(c("want"))
    df = df.withColumn("size", size).withColumn("take", F.greatest("size", F.lit(1)))
    upper = F.struct(c("pos").alias("pos"), F.upper("ref").alias("ref"), F.upper("alt").alias("alt"))
    # SNP: for each of its bases the next base column, up to the first without evidence
    steps = F.when(c("want") > 0, F.sequence(F.lit(0), c("want") - 1)).otherwise(F.array().cast("array<int>"))
    picks = at_cols(F.filter(F.transform(steps, lambda k: F.array_min(F.filter("bases", lambda b: b >= c("at") + k))), lambda i: i.isNotNull()))
    df = df.withColumn("picks", picks)
    blind = F.array_position(F.transform("picks", lambda x: x["seen"]), False)
    picks = F.slice("picks", F.lit(1), F.when(blind > 0, blind).otherwise(F.size("picks")).cast("int"))
    snp = F.when((F.size("picks") > 0) & F.array_contains("bases", c("at")), F.struct(place(c("at")).alias("pos"), text(picks, "rb").alias("ref"), text(picks, "other").alias("alt")))
    # insertion: the last base column before it, then its run of gap columns
    df = df.withColumn("before", F.array_max(F.filter("bases", lambda b: (b >= 1) & (b < c("at")))))
    stop = F.coalesce(F.get(F.filter("cols", lambda x: (x["i"] > c("before")) & ~x["gap"]), F.lit(0))["i"], c("width"))
    head = F.get(c("cols"), c("before"))
    run = F.slice("cols", c("before") + 2, F.least(c("take"), stop - c("before") - 1))
    ins = F.when(c("as_is"), upper).when(head["seen"], F.struct(place(c("before")).alias("pos"), head["rb"].alias("ref"), F.concat(head["rb"], text(run, "ab")).alias("alt")))
    # deletion: the base column before it and the base columns from it on; too few of them: as the candidate says
    ahead = F.array_max(F.filter("bases", lambda b: b < c("at")))
    body = at_cols(F.filter("bases", lambda b: b >= c("at")))
    head = F.get(c("cols"), ahead)["rb"]
    gone = F.when(F.size(body) < c("size"), upper).otherwise(F.struct(place(ahead).alias("pos"), F.concat(head, text(F.slice(body, F.lit(1), c("take")), "rb")).alias("ref"), head.alias("alt")))
    gone = F.when(F.array_contains("bases", c("at")) & ahead.isNotNull(), gone)
    p = lambda k: F.get(c("types"), F.lit(k))
    n = lambda k: F.get(c("lens"), F.lit(k))
    prob = F.when(c("kind") == "SNP", p(3) * n(1)).when((c("kind") == "INS") & c("as_is"), p(1)).when(c("kind") == "INS", p(1) * (1 - n(0))).otherwise(p(0) * (1 - n(0)))
    df = df.withColumns({"r": F.when(c("kind") == "SNP", snp).when(c("kind") == "INS", ins).otherwise(gone), "prob": prob})
    # one array of a record or none instead of filters, which would be pushed below and repeat all the columns they use
    skip = c("r.pos") - c("around_pos")
    same = (skip >= 0) & (F.upper(F.substr("around", skip + 1, F.length("r.ref"))) == c("r.ref"))
    good = c("at").isNotNull() & (F.abs(c("spot") - c("centre")) < far) & F.array_contains("bases", anchor) & same & (c("r.ref") != c("r.alt"))
    return df.select("id", F.explode(F.when(good, F.array(F.struct("r.pos", "r.ref", "r.alt", "prob")))).alias("r")).select("id", "r.*")
