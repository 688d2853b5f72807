"""Column functions on alleles, scores and bases: P10, P13, F5, F8-F12, F14-F17, F20, F25-F27, N5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "-ACGT"


def variant_type(ref: str | Column = "ref", alt: str | Column = "alt") -> Column:
    """P10: by the length of the first alternative allele."""
    d = F.length(ref) - F.length(F.split_part(alt, F.lit(","), F.lit(1)))
    return F.when(d > 0, "DEL").when(d < 0, "INS").otherwise("SNP")


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the longest common prefix."""
    n = F.least(F.length(a), F.length(b))
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1)))
    return F.when(n == 0, 0).otherwise(F.coalesce(F.array_min(differ) - 1, n))


def trimmed(pos: Column, ref: Column, alt: Column) -> Column:
    """struct (pos, ref, alt) without the shared suffix, then the shared prefix; one base stays."""
    room = lambda a, b: F.least(F.length(a), F.length(b)) - 1
    back = F.least(common_prefix(F.reverse(ref), F.reverse(alt)), room(ref, alt))
    r, a = F.left(ref, F.length(ref) - back), F.left(alt, F.length(alt) - back)
    front = F.least(common_prefix(r, a), room(r, a))
    rest = lambda x: F.substr(x, front + 1, F.length(x) - front)
    return F.struct((pos + front).alias("pos"), rest(r).alias("ref"), rest(a).alias("alt"))


def event_length(ref: Column, alt: Column) -> Column:
    """length that is left of the longer allele without shared prefix and suffix."""
    pre = common_prefix(ref, alt)
    rest = lambda x: F.substr(x, pre + 1, F.length(x) - pre)
    post = common_prefix(F.reverse(rest(ref)), F.reverse(rest(alt)))
    return F.greatest(F.length(ref), F.length(alt)) - pre - post


def is_part_of(pos: Column, ref: Column, alt: Column, pos2: Column, ref2: Column, alt2: Column) -> Column:
    """F8: whether one variant is a part of the other on one contig: an SNP inside a deletion (either
    way round), two of one type at one place, or two deletions that take a base in common."""
    a, b, na, nb = variant_type(ref, alt), variant_type(ref2, alt2), F.length(ref), F.length(ref2)
    common = (na > 1) & (nb > 1) & (F.greatest(pos, pos2) + 1 < F.least(pos + na, pos2 + nb))
    return (
        F.when((a == "SNP") & (b == "DEL"), (pos2 < pos) & (pos < pos2 + nb))
        .when((a == "DEL") & (b == "SNP"), (pos < pos2) & (pos2 < pos + na))
        .when(a == b, (pos == pos2) | ((a == "DEL") & common))
        .otherwise(False)
    )


def phred(p: Column) -> Column:
    """0 for 0, at most 100, rounded to 4 places."""
    return F.when(p <= 0, 0.0).when(p >= 1, 100.0).otherwise(F.least(F.lit(100.0), F.round(-10 * F.log10(1 - p), 4)))


def unphred(q: Column) -> Column:
    """F12."""
    return F.round(1 - F.pow(F.lit(10.0), -q / 10), 4)


def filter_label(score: Column, passed: float = 0.7, low: float = 0.4) -> Column:
    """P13."""
    return F.when(score >= passed, "PASS").when(score >= low, "LowQual").otherwise("REJECT")


def clean_bases(x: Column) -> Column:
    """upper case; whatever is not A, C, G or T becomes a gap."""
    return F.regexp_replace(F.upper(x), "[^ACGT]", "-")


def base_code(b: Column) -> Column:
    """the storage order, gap 0 to T 4; null for others."""
    return F.nullif(F.position(b, F.lit(BASES)), F.lit(0)) - 1


def tag_scale(tag: Column, length: Column) -> Column:
    """100 minus the tag in percent of the read length, within 0 and 100."""
    return F.greatest(F.least(100 - F.rint(tag / (0.001 + length) * 100), F.lit(100.0)), F.lit(0.0))


def score(kind: Column, p_del: Column, p_ins: Column, p_snp: Column, p_len0: Column, p_len1: Column) -> Column:
    """N5."""
    return F.when(kind == "SNP", p_snp * p_len1).when(kind == "INS", p_ins * (1 - p_len0)).when(kind == "DEL", p_del * (1 - p_len0)).otherwise(0.0)


def repeats_at(seq: Column, at: Column, unit: int) -> Column:
    """F16: whether the unit of this length at a 1-based place is repeated right after it."""
    return (F.substr(seq, at, F.lit(unit)) == F.substr(seq, at + unit, F.lit(unit))) & (F.length(seq) >= at + 2 * unit - 1)
