"""Deterministic views that turn the supplied tables into reads, variants, intervals and pileups.

One SQL text serves both engines: ``view`` runs it in Spark, ``ctes`` gives it to the oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

_REF = """case when k%5=0 then substring('ACGTACGTACGT',cast(1+k%4 as int),cast(2+k%4 as int))
       else substring('ACGTACGTACGT',cast(1+k%4 as int),1) end"""
_ALT = """case when k%5=1 then substring('ACGTACGTACGT',cast(1+k%4 as int),cast(2+k%4 as int))
       when k%5=0 then substring('ACGTACGTACGT',cast(1+k%4 as int),1)
       else substring('CGTACGTACGTA',cast(1+k%4 as int),1) end"""


def _variants(r: int) -> str:
    return f"""select k as id, contig, pos, {_REF} as ref, {_ALT} as alt, prob
from (select o_orderkey as k, cast(o_orderkey%22 as int) as contig, cast(1+o_orderkey%2000 as int) as pos,
  cast(o_orderkey%1000 as double)/1000.0 as prob from {{orders}} where o_orderkey%3={r}) t"""


def _sparse(records: str) -> str:
    """A query over spaced of records, each: kind, offset in the chunk (from 1), REF, ALT."""
    parts = []
    for n, r in enumerate(records.split(";")):
        kind, at, ref_alt = r.strip().split(", ", 2)
        depth, cut = 0, 0
        for i, c in enumerate(ref_alt):  # the comma between REF and ALT
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 0:
                cut = i
                break
        parts.append(f"select cast(k as bigint)*16+{n} as id, contig, cast(start+{at} as int) as pos, {ref_alt[:cut]} as ref, {ref_alt[cut + 2 :]} as alt from {{spaced}} where kind={kind}")
    return " union all ".join(parts)


TEXT = {
    "preds": _variants(0),
    "truth": _variants(1) + " union all select id+1000000000 as id, contig, pos, ref, alt, prob from {preds} where id%7=0",
    "known": _variants(2) + """ union all select id+1000000000 as id, contig, pos, ref, alt, prob from {preds} where id%11=0
union all select id+2000000000 as id, contig, pos, ref, 'N' as alt, prob from {preds} where id%22=0""",
    "bases": """select cast(l_suppkey%22 as int) as contig, cast(l_partkey as int) as pos,
cast((l_orderkey+l_linenumber)%5 as int) as code, cast(1+l_partkey%4 as int) as refcode,
case when l_linestatus='O' then 'tumor' else 'normal' end as sample, cast(l_quantity as int) as bq,
cast(l_linenumber*10 as int) as mapq, case when l_returnflag='A' then 1 else 0 end as fwd,
case when l_tax=0 then 1 else 0 end as lclip, case when l_discount=0 then 1 else 0 end as rclip from {lineitem}""",
    "reads": """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice,
cast(l_suppkey%22 as int) as contig, cast(l_partkey as int) as s, cast(l_partkey+l_quantity as int) as e,
cast(l_linenumber*10 as int) as mapq, l_discount=0 as is_dup, l_tax=0 as is_secondary, l_returnflag='R' as is_qcfail,
concat(cast(cast(l_quantity as int) as varchar(10)),'M',cast(l_linenumber as varchar(10)),'I',
cast(1+l_suppkey%7 as varchar(10)),'D',cast(1+l_partkey%9 as varchar(10)),'M') as cigar from {lineitem}""",
    "contigs": "select cast(n_nationkey as int) as ord, n_name as name, 2000 as len from {nation}",
    "cls": "select doc_id, quality as actual, toxic as predicted from {labels}",
    "runs": "select user_id, event_id, ts, event_type, value from {events}",
    # intervals: unique ids, half-open
    "iv": """select o_orderkey as id, cast(o_orderkey%11 as int) as contig, cast(o_orderkey*7%50000 as int) as s,
cast(o_orderkey*7%50000+1+o_orderkey%60 as int) as e from {orders} where o_orderkey%2=0""",
    "jv": """select o_orderkey as id, cast(o_orderkey%11 as int) as contig, cast(o_orderkey*13%50000 as int) as s,
cast(o_orderkey*13%50000+1+o_orderkey%90 as int) as e from {orders} where o_orderkey%2=1""",
    # raw candidates with evidence counts
    "raw": """select id, contig, pos, ref, alt, cast(5+id%90 as int) as dp, cast(id%60 as int) as ro, cast(id%35 as int) as ao,
cast(id%41 as int) as bq from {preds}""",
    # raw records of one base or N a side: deletions, insertions and SNPs
    "sites": """select k as id, contig, pos, case when k%4=2 then 'N' else substring('ACGT',cast(1+pos%4 as int),1) end as ref,
case when k%4<2 then 'N' when k%4=2 then substring('ACGT',cast(1+k%3 as int),1) else substring('CGTA',cast(1+pos%4 as int),1) end as alt,
cast(3+k%90 as int) as dp, cast(1+k%60 as int) as ro, cast(k%31 as int) as ao, cast(k%71 as int) as mq, cast(k%41 as int) as bq,
cast(k%13 as int) as st1, cast(k%17 as int) as st2, cast(k%5 as int) as ls, cast(k%7 as int) as rs, cast(k%11 as int) as nm,
cast(k%97 as int) as as_, cast(k%23 as int) as xs, cast(k%19 as int) as pr, cast(k%3 as int) as cl
from (select o_orderkey as k, cast(o_orderkey%22 as int) as contig, cast(1+o_orderkey*7%3000 as int) as pos from {orders}) t""",
    "refseq": """select cast(k%22 as int) as contig, cast(64*floor(k/22) as int) as start,
concat(substring('ACGTTGCAACGTGGCCTTAAACGTACGATCGATTACAGGATCCATGCATGCAACGTTTTACGGAC',cast(1+k%7 as int),57),'ACGTACG') as seq
from (select distinct l_suppkey*22+l_suppkey%22 as k from {lineitem}) t""",
    # a reference without holes, with tandem repeats, and regions beside them
    "genome": """select contig, start, substring(concat(substring(b,1,10), repeat(substring(b,cast(1+k%3 as int),cast(2+k%4 as int)), cast(3+k%9 as int)), b, b), 1, 64) as seq
from (select k, cast(k%22 as int) as contig, cast(64*floor(k/22) as int) as start, translate(md5(cast(k as varchar(20))), '0123456789abcdef', 'AACCGGTTACACGTGT') as b
from (select o_orderkey as k from {orders}) t) t""",
    "spots": """select k as id, cast(k%22 as int) as contig, cast(64*floor(k/22)+k%53 as int) as s, cast(64*floor(k/22)+k%53+2+k%19 as int) as e
from (select o_orderkey as k from {orders}) t""",
    # calls and truths a chunk apart, ten kinds: one for each rule of labelling that a record can reach
    "spaced": """select k, contig, start, seq, cast(k%10 as int) as kind, 2+cast(k%4 as int) as u, translate(seq, 'ACGT', 'CGTA') as other
from (select contig, start, seq, cast(floor(start/64) as int)*22+contig as k from {genome}) t""",
    "sparse_truth": _sparse("""
0, 30, substring(seq,30,1), substring(other,30,1); 1, 10, substring(seq,10,1+u), substring(seq,10,1);
2, 20, substring(seq,20,3), concat(substring(other,20,1), substring(seq,21,1), substring(other,22,1));
3, 10, substring(seq,10,1), substring(seq,10,1+u); 4, 20, substring(seq,20,1), substring(other,20,1); 4, 21, substring(seq,21,1), substring(other,21,1);
5, 30, substring(seq,30,4), substring(seq,30,1); 6, 30, substring(seq,30,1), concat(substring(seq,30,1), substring(other,31,1));
7, 30, substring(seq,30,1), concat(substring(seq,30,1), substring(other,31,1)); 8, 30, substring(seq,30,1), substring(other,30,1);
9, 50, substring(seq,50,1), substring(other,50,1)"""),
    "sparse_calls": _sparse("""
0, 30, substring(seq,30,1), substring(other,30,1); 1, 10+u, substring(seq,10+u,1+u), substring(seq,10+u,1);
2, 20, substring(seq,20,1), substring(other,20,1); 2, 22, substring(seq,22,1), substring(other,22,1);
3, 10+u, substring(seq,10+u,1), concat(substring(seq,10+u,1), substring(seq,11,u)); 4, 20, substring(seq,20,2), substring(other,20,2);
5, 32, substring(seq,32,1), substring(other,32,1); 6, 31, substring(seq,31,1), translate(substring(other,31,1), 'ACGT', 'CGTA');
7, 31, substring(seq,31,1), concat(substring(seq,31,1), substring(other,32,1), substring(other,32,1)); 8, 31, substring(seq,31,2), substring(seq,31,1);
8, 34, substring(seq,34,1), concat(substring(seq,34,1), substring(other,35,1)); 9, 30, substring(seq,30,1), substring(other,30,1)"""),
    # variants of four samples near the ends of chunks, which their groups cross
    "phased": """select k*8 as id, 0 as sample, contig, cast(start+58 as int) as s, cast(start+59 as int) as e, substring(other,58,1) as alt from {spaced} where k%3=0
union all select k*8+1, 0, contig, cast(start+63 as int), cast(start+63 as int), substring(other,1,u) from {spaced} where k%3=0
union all select k*8+2, 1, contig, cast(start+57 as int), cast(start+65+k%40 as int), substring(other,57,1) from {spaced} where k%3=0
union all select k*8+3, 1, contig, cast(start+60 as int), cast(start+61 as int), substring(other,60,1) from {spaced} where k%3=0
union all select k*8+4, 2, contig, cast(start+60 as int), cast(start+61 as int), substring(other,60,1) from {spaced} where k%3=0
union all select k*8+5, 2, contig, cast(start+62+k%30 as int), cast(start+64+k%30 as int), substring(other,62,2) from {spaced} where k%3=0
union all select k*8+6, 3, contig, cast(start+58 as int), cast(start+59 as int), substring(other,58,1) from {spaced} where k%3=0
union all select k*8+7, 3, contig, cast(start+63 as int), cast(start+63 as int), substring(other,1,u) from {spaced} where k%3=0""",
    "ann": """select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_extendedprice/1000.0 as depth,
l_quantity*1.6 as mq, l_discount*500 as bq, (l_tax-0.04)*5000 as nm_diff, l_discount*12 as flag, (l_quantity-25)*1.5 as rank_z from {lineitem}""",
}


def _needs(name: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", TEXT[name])))


def view(spark: SparkSession, sf_dir: str, name: str, **made: DataFrame) -> DataFrame:
    """A supplied table or one of the views above; views that are at hand already are passed by name."""
    if name in made:
        return made[name]
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spark.sql(TEXT[name], **{n: view(spark, sf_dir, n, **made) for n in _needs(name)})


def ctes(*names: str) -> str:
    """``WITH`` clause of the views, with what they need, for the oracle."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in TABLES or name in done:
            return
        for n in _needs(name):
            add(n)
        done[name] = TEXT[name].format(**{n: n for n in _needs(name)})

    for n in names:
        add(n)
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in done.items())
