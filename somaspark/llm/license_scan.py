"""License scan: ordered signature rules gated by keywords, overlaps resolved by containment.

A text is brought to its words (A-Z lower-cased; letters, digits and all beyond ASCII). A rule runs
only on texts that hold its keyword, found by one look into the set of the text's words. Its
matches are intervals of words. Of two detections of which one lies within the other, the one of
lower level goes, of one level the shorter, of equal intervals the one whose rule comes later; a
detection that overlaps another only in part says something of its own and stays. As this order
is transitive, a detection stays exactly if none of all detections goes before it.

The phrases of ``base`` are counted apart, at every place, and their labels always stay.

Defined results: a null or empty text has no word and no label; texts without any label have an empty
string and a score of 0; repeated rows are scanned each by itself; a very long text is matched whole;
an empty table gives an empty table; all columns of the input stay in the struct ``row``, so no name
can clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .license_rules import RULES
from .term_words import plain

BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: How sure a rule of a level is.
CONFIDENCE = {4: 1.0, 3: 0.9, 2: 0.75, 1: 0.5}
FOUND = "array<struct<label:string,level:int,first:long,last:long,confidence:double>>"


class Rule(NamedTuple):
    label: str
    level: int
    keyword: str
    pattern: str


@cache
def rules(text: str = RULES) -> tuple[Rule, ...]:
    parts = [line.split(" | ") for line in text.strip().splitlines()]
    return tuple(Rule(label, int(level), keyword, pattern) for label, level, keyword, pattern in parts)


def spaced(pattern: str) -> str:
    """The pattern over words that have a space on each side of their own, so that matches may touch."""
    return f" {pattern.replace(' ', '  ')} ".replace("[^  ]", "[^ ]")


@cache
def gate(text: str = RULES) -> dict[bytes, list[tuple[int, Rule, re.Pattern[bytes]]]]:
    """Keyword -> its rules, with their numbers."""
    out: dict[bytes, list[tuple[int, Rule, re.Pattern[bytes]]]] = {}
    for i, r in enumerate(rules(text)):
        out.setdefault(r.keyword.encode(), []).append((i, r, re.compile(spaced(r.pattern).encode())))
    return out


def detections(words: Sequence[bytes], text: str = RULES) -> list[tuple[int, int, int, int]]:
    """(rule, level, first word, last word) of all matches."""
    known = gate(text)
    hits = known.keys() & set(words)
    if not hits:
        return []
    line = b" " + b"  ".join(words) + b" "
    starts = np.cumsum([0, *(len(w) + 2 for w in words)])  # of each word's own space
    out = []
    for k in hits:
        for i, r, pattern in known[k]:
            for m in pattern.finditer(line):
                out.append((i, r.level, *(int(x) for x in np.searchsorted(starts, (m.start(), m.end() - 1), "right") - 1)))
    return out


def resolved(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The detections that stay, by place. One sweep a level, higher levels first."""
    stay: list[tuple[int, int, int, int]] = []
    for level in sorted({d[1] for d in found}, reverse=True):
        own = sorted((d for d in found if d[1] == level), key=lambda d: (d[2], -d[3], d[0]))
        above = sorted((d[2], d[3]) for d in stay)
        reach_above, reach, at = -1, -1, 0
        for d in own:
            while at < len(above) and above[at][0] <= d[2]:
                reach_above = max(reach_above, above[at][1])
                at += 1
            if d[3] > reach_above and d[3] > reach:
                stay.append(d)
            reach = max(reach, d[3])
    return sorted(stay, key=lambda d: (d[2], d[3], d[0]))


def places(words: Sequence[bytes], phrase: str) -> list[int]:
    """Where the phrase's words stand one after the other."""
    first, *rest = phrase.encode().split()
    out, at = [], -1
    try:
        while True:
            at = words.index(first, at + 1)
            if list(words[at + 1 : at + 1 + len(rest)]) == rest:
                out.append(at)
    except ValueError:
        return out


def license_scan(docs: DataFrame, base: Sequence[tuple[str, str]] = BASE, text: str = RULES) -> DataFrame:
    """row (all columns of docs), n_words, base (label, word) of every base phrase, found: what stays."""
    kind = f"n_words long, base array<struct<label:string,word:long>>, found {FOUND}"
    spot = pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))
    hit = pa.list_(pa.struct([("label", pa.string()), ("level", pa.int32()), ("first", pa.int64()), ("last", pa.int64()), ("confidence", pa.float64())]))
    firsts = {p.split()[0].encode() for p, _ in base}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        all_rules = rules(text)
        for whole in batches:
            for b in (whole.slice(i, 512) for i in range(0, whole.num_rows, 512)):
                n, spots, hits = [], [], []
                for t in b.column("row").field("text"):
                    words = plain(t.as_py()).split()
                    n.append(len(words))
                    spots.append([{"label": label, "word": w} for phrase, label in base for w in places(words, phrase)] if firsts else [])
                    hits.append([{"label": all_rules[i].label, "level": level, "first": a, "last": z, "confidence": CONFIDENCE[level]} for i, level, a, z in resolved(detections(words, text))])
                yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(n, pa.int64()), pa.array(spots, spot), pa.array(hits, hit)], ["row", "n_words", "base", "found"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {kind}")
