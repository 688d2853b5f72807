"""Running values along an order without a window over a whole group, and cut lineage.

Rows fall into stretches of their order. Each stretch is folded to one row; only those rows meet in
a window over the group, and what they carry joins back, so that every other window is dealt by
(group, stretch). A group has as many such rows as its order has stretches, whatever the input.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SIZE = 1 << 16


def carried(df: DataFrame, by: list[str], stretch: Column, before: dict | None = None, after: dict | None = None) -> DataFrame:
    """df with stretch and, for each name: (aggregate, column), the aggregate over all rows of the
    earlier (before) or later (after) stretches of the group; null without one."""
    before, after = before or {}, after or {}
    df = df.withColumn("stretch", stretch)
    both = before | after
    per = df.groupBy(*by, "stretch").agg(*[f(F.col(c) if isinstance(c, str) else c).alias(n) for n, (f, c) in both.items()])
    w = Window.partitionBy(*by).orderBy("stretch")
    earlier, later = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(1, Window.unboundedFollowing)
    over = [f(n).over(earlier if n in before else later).alias(n) for n, (f, _) in both.items()]
    return df.join(per.select(*by, "stretch", *over), [*by, "stretch"])


def inside(by: list[str], *order: str | Column) -> Window:
    """The window of a stretch."""
    return Window.partitionBy(*by, "stretch").orderBy(*order)


def up_to(w, last: int = 0):
    return w.rowsBetween(Window.unboundedPreceding, last)


def numbered(df: DataFrame, by: list[str], stretch: Column, *order: str | Column) -> DataFrame:
    """df with k, the row's number (from 0) within its group in the order; stretch grows with the order."""
    df = carried(df, by, stretch, before={"k0": (F.sum, F.lit(1))})
    return df.withColumn("k", F.coalesce("k0", F.lit(0)) + F.row_number().over(inside(by, *order)) - 1).drop("k0", "stretch")


def folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names, which the driver and all executors share; where it
    is unset, a local one under a local master and an error elsewhere."""
    got = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="tables-")
        atexit.register(shutil.rmtree, path, True)
        got = f"file://{path}"
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def kept(df: DataFrame, *by: str) -> DataFrame:
    """df written to the shared folder and read back: its lineage is cut, lost executors do no harm.
    by: columns of few values; a filter on them reads its own files only."""
    path = f"{folder(df.sparkSession)}/kept-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
