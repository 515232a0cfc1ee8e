"""Audits: quality of the sources, the ground truth, and its matched pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.metrics import pair_space, ratio
from tessera.functions.text import excerpt, has_devanagari, norm_audit


def source_stats(records: DataFrame) -> DataFrame:
    """Rows, distinct ids and names, repeated ids and empty fields by source."""
    empty = lambda c: F.count_if(F.col(c) == "")
    s = records.groupBy("source").agg(
        F.count("*").alias("total_rows"), F.count_distinct("entity_id").alias("unique_ids"), F.count_distinct("business_name").alias("unique_names"),
        empty("business_name").alias("empty_names"), empty("business_address").alias("empty_addresses"), empty("country").alias("empty_countries"),
    )
    return s.withColumn("duplicate_ids", F.col("total_rows") - F.col("unique_ids"))


def length_stats(records: DataFrame, filled_only: bool = True) -> DataFrame:
    """Lengths of the non-empty (or all) names and addresses by source."""
    long = records.select("source", F.stack(F.lit(2), F.lit("name"), F.col("business_name"), F.lit("address"), F.col("business_address")).alias("field", "value"))
    if filled_only:
        long = long.where("value <> ''")
    n = F.length("value")
    return long.groupBy("source", "field").agg(
        F.avg(n).alias("mean_len"), F.median(n).alias("median_len"), F.min(n).alias("min_len"), F.max(n).alias("max_len"), F.percentile(n, 0.95).alias("p95_len"),
    )


def country_distribution(records: DataFrame) -> DataFrame:
    return records.groupBy("source", "country").agg(F.count("*").alias("n"))


def match_counts(summary: DataFrame) -> DataFrame:
    return summary.groupBy("match_count").agg(F.count("*").alias("n"))


def match_classes(summary: DataFrame) -> DataFrame:
    """Entities with 0, 1, 2, 3 and more matches, and mean, median and most."""
    c = F.col("match_count")
    return summary.agg(
        *[F.count_if(c == k).alias(f"matches_{k}") for k in range(4)], F.count_if(c >= 4).alias("matches_4_plus"),
        F.avg(c).alias("mean_matches"), F.median(c).alias("median_matches"), F.max(c).alias("max_matches"), F.sum(c).alias("total_matches"),
    )


def source_overlap(truth: DataFrame) -> DataFrame:
    """How many entities have matches in both sources, in one, and several in one."""
    per = truth.groupBy("source1_entity_id").agg(F.count_if(F.col("target_entity_id").startswith("S2-")).alias("s2"), F.count_if(F.col("target_entity_id").startswith("S3-")).alias("s3"))
    s2, s3 = F.col("s2"), F.col("s3")
    return per.agg(
        F.coalesce(F.sum("s2"), F.lit(0)).alias("s2_total"), F.coalesce(F.sum("s3"), F.lit(0)).alias("s3_total"), F.count_if((s2 > 0) & (s3 > 0)).alias("both"),
        F.count_if((s2 > 0) & (s3 == 0)).alias("only_s2"), F.count_if((s2 == 0) & (s3 > 0)).alias("only_s3"), F.count_if(s2 > 1).alias("multi_s2"), F.count_if(s3 > 1).alias("multi_s3"),
    )


def multi_assigned(truth: DataFrame) -> DataFrame:
    """Targets that several entities claim, with the number of those."""
    return truth.groupBy("target_entity_id").agg(F.count_distinct("source1_entity_id").alias("owners")).where("owners > 1")


def hydrated(truth: DataFrame, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """The true pairs with the fields of both records."""
    fields = ["business_name", "business_address", "country"]
    left = s1.select(F.col("entity_id").alias("source1_entity_id"), *[F.col(f).alias(f"s1_{f}") for f in fields])
    right = targets.select(F.col("entity_id").alias("target_entity_id"), *[F.col(f).alias(f"m_{f}") for f in fields])
    return truth.join(left, "source1_entity_id", "left").join(right, "target_entity_id", "left")


def exact_rates(pairs: DataFrame) -> DataFrame:
    """How many true pairs agree in raw and normalized name and address, and in country."""
    same = lambda f: F.col(f"s1_{f}") == F.col(f"m_{f}")
    norm = pairs.withColumns({f"{s}_norm_{k}": norm_audit(F.col(f"{s}_business_{k}")) for s in ("s1", "m") for k in ("name", "address")})
    filled = lambda k: same(f"norm_{k}") & (F.col(f"s1_norm_{k}") != "")
    counts = norm.agg(
        F.count("*").alias("total_pairs"), F.count_if(same("business_name")).alias("raw_name"), F.count_if(same("business_address")).alias("raw_address"),
        F.count_if(filled("name")).alias("norm_name"), F.count_if(filled("address")).alias("norm_address"),
        F.count_if(same("country")).alias("country_match"), F.count_if(F.col("s1_country") != F.col("m_country")).alias("country_mismatch"),
    )
    return counts.withColumns({f"{k}_rate": ratio(F.col(k), F.col("total_pairs")) for k in ("raw_name", "raw_address", "norm_name", "norm_address")})


def script_mismatch(pairs: DataFrame, a: str = "s1_business_name", b: str = "m_business_name") -> DataFrame:
    """Pairs of which one name only has Devanagari letters."""
    return pairs.where(has_devanagari(F.col(a)) != has_devanagari(F.col(b)))


def missing_asymmetry(pairs: DataFrame) -> DataFrame:
    """Pairs in which one side only has a name, or an address."""
    one = lambda a, b: F.count_if((F.col(a) == "") & (F.col(b) != ""))
    return pairs.agg(
        one("s1_business_name", "m_business_name").alias("missing_name_s1"), one("m_business_name", "s1_business_name").alias("missing_name_match"),
        one("s1_business_address", "m_business_address").alias("missing_addr_s1"), one("m_business_address", "s1_business_address").alias("missing_addr_match"),
    )


def variations(pairs: DataFrame, field: str, limit: int = 20, width: int = 100) -> DataFrame:
    """The first true pairs by id whose field differs."""
    rows = pairs.where(F.col(f"s1_{field}") != F.col(f"m_{field}")).orderBy("source1_entity_id", "target_entity_id").limit(limit)
    return rows.select("source1_entity_id", "target_entity_id", excerpt(F.col(f"s1_{field}"), width).alias("s1_value"), excerpt(F.col(f"m_{field}"), width).alias("match_value"))


def brute_force_space(records: DataFrame) -> DataFrame:
    """The number of pairs of S1 records and targets, over all and within countries."""
    by = records.groupBy("country").agg(F.count_if(F.col("source") == "S1").alias("s1"), F.count_if(F.col("source") != "S1").alias("targets"))
    return by.agg(F.sum("s1").alias("s1_rows"), F.sum("targets").alias("target_rows"), F.sum(F.col("s1") * F.col("targets")).alias("blocked_pairs")).withColumn(
        "all_pairs", pair_space(F.col("s1_rows"), F.col("target_rows")).cast("decimal(38,0)").cast("long"))
