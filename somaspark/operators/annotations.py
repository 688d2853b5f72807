"""annotation features of a call set, clipped to the limits of their group and moved to [0, 1]."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tensors import scaled

#: Limits and names of the groups (fixed values).
LIMITS = (
    (0, 100, """Consistent_Mates Inconsistent_Mates N_DP nBAM_REF_NM nBAM_ALT_NM nBAM_REF_Concordant nBAM_REF_Discordant nBAM_ALT_Concordant nBAM_ALT_Discordant
     N_REF_FOR N_REF_REV N_ALT_FOR N_ALT_REV nBAM_REF_Clipped_Reads nBAM_ALT_Clipped_Reads nBAM_MQ0 nBAM_Other_Reads nBAM_Poor_Reads
     nBAM_REF_InDel_3bp nBAM_REF_InDel_2bp nBAM_REF_InDel_1bp nBAM_ALT_InDel_3bp nBAM_ALT_InDel_2bp nBAM_ALT_InDel_1bp
     T_DP tBAM_REF_NM tBAM_ALT_NM tBAM_REF_Concordant tBAM_REF_Discordant tBAM_ALT_Concordant tBAM_ALT_Discordant T_REF_FOR T_REF_REV T_ALT_FOR T_ALT_REV
     tBAM_REF_Clipped_Reads tBAM_ALT_Clipped_Reads tBAM_MQ0 tBAM_Other_Reads tBAM_Poor_Reads
     tBAM_REF_InDel_3bp tBAM_REF_InDel_2bp tBAM_REF_InDel_1bp tBAM_ALT_InDel_3bp tBAM_ALT_InDel_2bp tBAM_ALT_InDel_1bp"""),
    (0, 70, "nBAM_REF_MQ nBAM_ALT_MQ tBAM_REF_MQ tBAM_ALT_MQ"),
    (0, 41, "nBAM_REF_BQ nBAM_ALT_BQ tBAM_REF_BQ tBAM_ALT_BQ"),
    (-100, 100, "nBAM_NM_Diff tBAM_NM_Diff"),
    (0, 1, """if_MuTect if_VarScan2 if_SomaticSniper if_VarDict MuSE_Tier if_Strelka nBAM_Concordance_FET nBAM_StrandBias_FET nBAM_Clipping_FET
     tBAM_Concordance_FET tBAM_StrandBias_FET tBAM_Clipping_FET if_dbsnp COMMON M2_STR"""),
    (-30, 30, "nBAM_Z_Ranksums_MQ nBAM_Z_Ranksums_BQ nBAM_Z_Ranksums_EndPos tBAM_Z_Ranksums_BQ tBAM_Z_Ranksums_MQ tBAM_Z_Ranksums_EndPos"),
    (0, 40, "Strelka_Score"),
    (0, 200, "Strelka_QSS"),
    (0, 4, "Strelka_TQSS"),
    (0, 60, "VarScan2_Score"),
    (0, 120, "VarDict_Score"),
    (0, 100, "M2_NLOD M2_TLOD"),
    (0, 120, "Sniper_Score"),
    (0, 40, "M2_ECNT"),
    (0, 100, "SOR"),
    (0, 100, "MSI"),
    (0, 10, "MSILEN"),
    (0, 100, "SHIFT3"),
    (0, 50, "MaxHomopolymer_Length"),
    (0, 50, "SiteHomopolymer_Length"),
    (-30, 30, "InDel_Length"),
)
FEATURES = {name: (lo, hi) for lo, hi, names in LIMITS for name in names.split()}


def all_scaled(df: DataFrame, keys: list[str]) -> DataFrame:
    """The keys and all known features that df has, scaled, in df's order; other columns go.

    A null or NaN counts as 0, before clipping; a df that lacks a feature is an error."""
    if missing := [c for c in FEATURES if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    number = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))
    return df.select(*keys, *[scaled(number(c), *FEATURES[c]).alias(c) for c in df.columns if c in FEATURES])


def write_scaled(df: DataFrame, path: str) -> None:
    """K9: the scaled rows as tab-separated files with a header each."""
    df.write.option("header", True).csv(path, sep="\t")
