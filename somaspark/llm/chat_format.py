"""Chat formatting with Spark expressions only.

A conversation becomes one string of blocks. A block holds adjacent turns of one role::

    ### role:\\n text [<+turn> text ...] </turn>\\n

Control strings inside roles and texts are escaped by codes that start with a backslash, so that
they never occur in a formatted text by accident; ``parse_turns`` reads the turns back exactly.

Defined results: a null text or role is the empty string; a null conv_id is a conversation of its
own; turns sort by (turn, role, text), nulls first, so ties and repeated rows have one order and
all stay; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

HEAD, COLON, JOINT, END = "### ", ":\n", "<+turn>", "</turn>\n"
#: Escapes, in the order in which they are applied; a backslash in escaped text always starts a code.
CODES = (("\\", "\\b"), ("</turn>", "\\t"), ("<+turn>", "\\j"), ("### ", "\\h"))
ROLE_CODES = (*CODES, ("\n", "\\n"))
BLOCK = 256


def escape(c: Column, codes: tuple = CODES) -> Column:
    for plain, code in codes:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column, codes: tuple = CODES) -> Column:
    for plain, code in reversed(codes):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x) with x evaluated once, however often f uses it inside lambdas."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def starts_of(lens: Column) -> Column:
    """Exclusive prefix sums of an array of longs, by blocks, so that long arrays stay cheap."""

    def of(xs: Column) -> Column:
        heads = F.sequence(F.lit(0), F.greatest(F.size(xs) - 1, F.lit(0)), F.lit(BLOCK))
        blocks = F.transform(heads, lambda h: F.slice(xs, h + 1, F.lit(BLOCK)))
        first = F.array(F.lit(0).cast("long"))
        bases = F.aggregate(F.transform(blocks, _total), first, lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
        inside = F.zip_with(blocks, bases, lambda b, base: F.transform(b, lambda _, j: base + _total(F.slice(b, F.lit(1), j))))
        return F.flatten(F.filter(inside, lambda b: b.isNotNull()))  # bases has one element more

    return let(lens, of)


def format_conversations(rows: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, loss: one row a conversation. loss: array of (at, bytes), byte spans of the
    UTF-8 form that hold the (escaped) texts under the loss mask, one a turn."""
    turns = F.sort_array(F.collect_list(F.struct("turn", text_or_empty("role").alias("role"), text_or_empty("text").alias("text"))))
    df = rows.groupBy("conv_id").agg(turns.alias("turns"))

    def parts_of(turns: Column) -> Column:
        roles = F.transform(turns, lambda t: t["role"])
        none = F.array(F.lit(None).cast("string"))
        joined = F.arrays_zip(turns.alias("t"), F.concat(none, roles).alias("before"), F.concat(F.slice(roles, F.lit(2), F.size(roles)), none).alias("after"))
        part = lambda x: F.struct(
            F.when(x["before"].eqNullSafe(x["t"]["role"]), F.lit(JOINT)).otherwise(F.concat(F.lit(HEAD), escape(x["t"]["role"], ROLE_CODES), F.lit(COLON))).alias("head"),
            escape(x["t"]["text"]).alias("body"),
            F.when(x["after"].eqNullSafe(x["t"]["role"]), F.lit("")).otherwise(F.lit(END)).alias("tail"),
            x["t"]["role"].isin(*loss_roles).alias("loss"),
        )
        return F.transform(F.filter(joined, lambda x: x["t"].isNotNull()), part)  # before has one element more

    def spans_of(parts: Column) -> Column:
        lens = F.transform(parts, lambda p: (F.octet_length(p["head"]) + F.octet_length(p["body"]) + F.octet_length(p["tail"])).cast("long"))
        spans = F.zip_with(parts, starts_of(lens), lambda p, at: F.struct(p["loss"].alias("loss"), (at + F.octet_length(p["head"])).alias("at"), F.octet_length(p["body"]).cast("long").alias("bytes")))
        return F.transform(F.filter(spans, lambda s: s["loss"]), lambda s: F.struct(s["at"].alias("at"), s["bytes"].alias("bytes")))

    both = lambda parts: F.struct(F.array_join(F.transform(parts, lambda p: F.concat(p["head"], p["body"], p["tail"])), "").alias("formatted"), spans_of(parts).alias("loss"))
    return df.select("conv_id", let(let(F.col("turns"), parts_of), both).alias("made")).select("conv_id", "made.formatted", "made.loss")


def parse_turns(formatted: Column) -> Column:
    """The array of (role, text) that a formatted string holds."""
    blocks = let(F.split(formatted, r"\Q</turn>" + "\n" + r"\E", -1), lambda b: F.slice(b, F.lit(1), F.greatest(F.size(b) - 1, F.lit(0))))
    role = lambda b: unescape(F.regexp_extract(b, r"(?s)\A### ([^\n]*):\n", 1), ROLE_CODES)
    texts = lambda b: F.split(F.regexp_replace(b, r"\A### [^\n]*:\n", ""), r"\Q<+turn>\E", -1)
    read = F.transform(blocks, lambda b: F.struct(role(b).alias("role"), texts(b).alias("texts")))
    return F.flatten(F.transform(read, lambda r: F.transform(r["texts"], lambda t: F.struct(r["role"].alias("role"), unescape(t).alias("text")))))


def loss_texts(formatted: Column, loss: Column) -> Column:
    """The unescaped texts under the loss mask, in order."""
    cut = lambda data, s: unescape(F.substring(data, (s["at"] + 1).cast("int"), s["bytes"].cast("int")).cast("string"))
    return let(F.encode(formatted, "UTF-8"), lambda data: F.transform(loss, lambda s: cut(data, s)))
