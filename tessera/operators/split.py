"""Sampling and the stratified split, by hash of the id and so the same on any cluster."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_order(key: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary"))


def hash_sample(df: DataFrame, key: str, fraction: float, seed: int = 42) -> DataFrame:
    """About `fraction` of the rows: those whose hash is in the first part of the range."""
    limit = f"{int(fraction * 16**8):08x}"
    return df.where(F.substring(hash_order(F.col(key), seed), 1, 8) < limit)


def stratum(country: Column, matches: Column) -> Column:
    return F.concat_ws("_", country, F.when(matches == 0, "0").when(matches == 1, "1").otherwise("multi"))


#: Ranges of the hash within which a stratum's rows are ranked.
_RANGE_DIGITS = 4


def stratified_split(summary: DataFrame, share: float = 0.2, seed: int = 42) -> DataFrame:
    """The summary with its stratum and is_val: of each stratum the first round(share * n) by hash.

    No task sorts a stratum: rows are ranked within (stratum, range of the hash), and the rows of
    the ranges before, of which there are at most 16 ** 4 a stratum, are added from their counts."""
    order = hash_order(F.col("source1_entity_id"), seed)
    rows = summary.withColumn("stratum", stratum(F.col("country"), F.col("match_count"))).withColumn("__order", order)
    rows = rows.withColumn("__range", F.coalesce(F.substring("__order", 1, _RANGE_DIGITS), F.lit("")))
    counts = rows.groupBy("stratum", "__range").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("stratum")
    earlier = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    left = counts.select("stratum", "__range", (F.round(F.sum("n").over(whole) * share) - F.coalesce(F.sum("n").over(earlier), F.lit(0))).alias("__left"))
    ranked = rows.withColumn("__nth", F.row_number().over(Window.partitionBy("stratum", "__range").orderBy("__order", "source1_entity_id")))
    joined = ranked.join(left, ["stratum", "__range"])
    return joined.select(*summary.columns, "stratum", (F.col("__nth") <= F.col("__left")).alias("is_val"))
