"""Hard negatives: generic names, and pairs that agree in name but are no match."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.metrics import f_beta, ratio
from tessera.functions.text import norm_light
from tessera.operators.evaluate import label
from tessera.operators.signals import Signal, candidates, filled, without_heavy_keys
from tessera.operators.split import hash_sample


def union_candidates(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs that either of two candidate sets has, each once."""
    return a.select("s1_id", "target_id").union(b.select("s1_id", "target_id")).distinct()


def union_recall(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    marked = label(pairs, truth)
    return marked.agg(F.count("*").alias("total_candidates"), F.count_if("is_tp").alias("tp"), F.count_if(~F.col("is_tp")).alias("fp"))


def address_conflicts(s1: DataFrame, targets: DataFrame, truth: DataFrame) -> DataFrame:
    """Of the pairs with equal country and normalized name (empty ones too): how many false
    ones have two addresses, different ones, or none at the target."""
    left = s1.select(F.col("entity_id").alias("s1_id"), "country", "norm_name", F.col("norm_addr").alias("a"))
    right = targets.select(F.col("entity_id").alias("target_id"), "country", "norm_name", F.col("norm_addr").alias("b"))
    marked = label(left.join(right, ["country", "norm_name"]), truth)
    false, both = ~F.col("is_tp"), (F.col("a") != "") & (F.col("b") != "")
    return marked.agg(
        F.count("*").alias("total_pairs"), F.count_if("is_tp").alias("total_tp"), F.count_if(false).alias("total_fp"), F.count_if(false & both).alias("fp_both_addrs"),
        F.count_if(false & both & (F.col("a") != F.col("b"))).alias("fp_different_addrs"), F.count_if(false & (F.col("b") == "")).alias("fp_missing_target_addr"),
    )


def top_names(targets: DataFrame, limit: int = 25) -> DataFrame:
    return targets.groupBy("business_name").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "business_name").limit(limit)


def name_counts(records: DataFrame, names: DataFrame) -> DataFrame:
    """For each given name (column `name`): records by source and the pairs they could make."""
    wanted = names.select("name", F.lower("name").alias("low"))
    found = records.select("source", F.lower("business_name").alias("low")).join(wanted, "low")
    counts = found.groupBy("name").agg(*[F.count_if(F.col("source") == s).alias(s.lower()) for s in ("S1", "S2", "S3")])
    every = names.join(counts, "name", "left").na.fill(0)
    return every.withColumns({"s2_s3": F.col("s2") + F.col("s3"), "potential_pairs": F.col("s1") * (F.col("s2") + F.col("s3"))})


def name_dives(s1: DataFrame, targets: DataFrame, truth: DataFrame, names: DataFrame) -> DataFrame:
    """For each given name: its pairs within countries, right and false ones, and both sides' records."""
    wanted = names.select("name", F.lower("name").alias("low"))
    left = s1.select(F.col("entity_id").alias("s1_id"), "country", F.lower("business_name").alias("low")).join(wanted, "low")
    right = targets.select(F.col("entity_id").alias("target_id"), "country", F.lower("business_name").alias("low")).join(wanted, "low").drop("name")
    marked = label(left.join(right, ["low", "country"]), truth)
    counts = marked.groupBy("name").agg(
        F.count("*").alias("pairs"), F.count_if("is_tp").alias("tp"), F.count_if(~F.col("is_tp")).alias("fp"),
        F.count_distinct("s1_id").alias("unique_s1"), F.count_distinct("target_id").alias("unique_targets"),
    )
    return names.select("name").join(counts, "name", "left").na.fill(0)


def hard_negatives(s1: DataFrame, targets: DataFrame, truth: DataFrame, longer_than: int = 8, limit: int = 20) -> DataFrame:
    """The first pairs by id that agree in light name and country, are no match, and whose name
    is long enough not to be generic."""
    side = lambda df, p: df.select(F.col("entity_id").alias(f"{p}_id"), norm_light(F.col("business_name")).alias("norm"), "country", F.col("business_name").alias(f"{p}_name"), F.col("business_address").alias(f"{p}_addr")).where(F.length("norm") > longer_than)
    pairs = side(s1, "s1").join(side(targets, "s2"), ["norm", "country"])
    known = truth.select(F.col("source1_entity_id").alias("s1_id"), F.col("target_entity_id").alias("s2_id"))
    rows = pairs.join(known, ["s1_id", "s2_id"], "left_anti").orderBy("s1_id", "s2_id").limit(limit)
    return rows.select("s1_id", "s2_id", "s1_name", "s2_name", "s1_addr", "s2_addr")


def sampled_signal(field: tuple[str, ...], s1: DataFrame, targets: DataFrame, truth: DataFrame, fraction: float = 0.1, heavy: int = 100_000) -> DataFrame:
    """A signal within countries on a sample of S1, without very frequent keys, scaled up.

    Keys are frequent by the first field alone, over targets whose other fields are blank too;
    a blank in any field matches nothing."""
    sample = hash_sample(s1, "entity_id", fraction)
    left, right = without_heavy_keys(filled(sample, field[:1]), filled(targets, field[:1]), field[0], heavy)
    left, right = filled(left, field[1:]), filled(right, field[1:])
    keys = ["country", *field]
    pairs = left.select(F.col("entity_id").alias("s1_id"), *keys).join(right.select(F.col("entity_id").alias("target_id"), *keys), keys).select("s1_id", "target_id")
    known = truth.join(sample.select(F.col("entity_id").alias("source1_entity_id")), "source1_entity_id", "left_semi")
    marks = label(pairs, known).select(F.lit(1).alias("cand"), F.col("is_tp").cast("int").alias("hit"), F.lit(0).alias("true"))
    found = marks.unionByName(known.select(F.lit(0).alias("cand"), F.lit(0).alias("hit"), F.lit(1).alias("true")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    s = found.agg(total("cand").alias("cands"), total("hit").alias("tp"), total("true").alias("true_pairs"))
    scale = round(1 / fraction)
    s = s.withColumns({"fp": F.col("cands") - F.col("tp"), "fn": F.col("true_pairs") - F.col("tp")})
    s = s.withColumns({"precision": ratio(F.col("tp"), F.col("cands")), "recall": ratio(F.col("tp"), F.col("true_pairs"))})
    return s.select(
        F.lit("_".join(field)).alias("signal"), (F.col("cands") * scale).alias("candidate_count"), (F.col("tp") * scale).alias("tp"), (F.col("fp") * scale).alias("fp"),
        (F.col("fn") * scale).alias("fn"), "precision", "recall", f_beta(F.col("precision"), F.col("recall")).alias("f05"),
    )


def blocked_pairs(signal: Signal, s1: DataFrame, targets: DataFrame, heavy: int) -> DataFrame:
    """A signal's candidates without the keys that more than `heavy` targets have."""
    left, right = without_heavy_keys(filled(s1, signal.fields), filled(targets, signal.fields), signal.fields[0], heavy)
    return candidates(signal, left, right)
