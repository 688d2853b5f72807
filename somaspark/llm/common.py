"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: everything between these ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir); where that is unset, a local one under a
    local master and an error on a cluster, whose executors would not see it."""
    got = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not got:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        got = "file://" + tempfile.mkdtemp(prefix="scratch-")
        atexit.register(shutil.rmtree, got[7:], True)
        spark.conf.set("spark.checkpoint.dir", got)
    return got.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """df written to the shared folder and read back: cuts the lineage, survives a lost executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: A key with more than a HOT_PARTS-th of all rows is dealt over several tasks.
HOT_PARTS = 1024


def hot_keys(counted: DataFrame, keys: list[str], n: str, total: int) -> DataFrame:
    """keys, salts: the keys whose n exceeds a HOT_PARTS-th of total, the sum of n, with salts in
    proportion. There are fewer than HOT_PARTS such keys whatever the input, so they may be broadcast."""
    share = max(1, total // HOT_PARTS)
    return counted.where(F.col(n) > share).select(*keys, F.ceil(F.col(n) / share).cast("int").alias("salts"))


def salted(df: DataFrame, groups: DataFrame, keys: list[str], by: list[str], hot: DataFrame, how: str = "inner") -> DataFrame:
    """df joined with groups (one row a key); rows of a hot key are dealt over its salts by a hash of
    the columns by, and its row of groups is repeated for each salt."""
    hot = F.broadcast(hot)
    salts = F.coalesce("salts", F.lit(1))
    many = groups.join(hot, keys, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("salts")
    dealt = df.join(hot, keys, "left").withColumn("salt", F.pmod(F.xxhash64(*by), salts).cast("int")).drop("salts")
    return dealt.join(many, [*keys, "salt"], how).drop("salt")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(c: str | Column) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file; PUBLIC_TOKENIZERS_DIR overrides the installed folder."""
    if folder := os.environ.get("PUBLIC_TOKENIZERS_DIR"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))
