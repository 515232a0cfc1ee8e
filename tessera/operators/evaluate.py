"""Labels, per-entity counts, and metric panels of a candidate set."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.metrics import entity_f05, f_beta, ratio, reduction_ratio
from tessera.operators.signals import Signal, filled

COUNTS = ["pred_count", "tp_count", "s2_pred_count", "s3_pred_count", "s2_tp_count", "s3_tp_count"]


def label(pairs: DataFrame, truth: DataFrame) -> DataFrame:
    """The pairs with is_tp."""
    known = truth.select(F.col("source1_entity_id").alias("s1_id"), F.col("target_entity_id").alias("target_id"), F.lit(True).alias("known"))
    return pairs.join(known, ["s1_id", "target_id"], "left").withColumn("is_tp", F.col("known").isNotNull()).drop("known")


def counts_of_pairs(labeled: DataFrame) -> DataFrame:
    """Counts by S1 record of labelled pairs."""
    s2, s3, right = F.col("target_source") == "S2", F.col("target_source") == "S3", F.col("is_tp")
    return labeled.groupBy("s1_id").agg(
        F.count("*").alias("pred_count"), F.count_if(right).alias("tp_count"),
        F.count_if(s2).alias("s2_pred_count"), F.count_if(s3).alias("s3_pred_count"),
        F.count_if(s2 & right).alias("s2_tp_count"), F.count_if(s3 & right).alias("s3_tp_count"),
    )


def counts_of_signal(signal: Signal, s1: DataFrame, targets: DataFrame, truth: DataFrame) -> DataFrame:
    """The same counts for a signal without making its pairs.

    Equal keys make a pair, so the pairs of a record are as many as targets have its key:
    targets are summed up by key before the join. Right pairs are the true ones whose two
    records share the keys. Work and shuffle grow with the rows, not with the pairs.
    """
    s2, s3 = F.col("source") == "S2", F.col("source") == "S3"
    by_key = filled(targets, signal.fields).groupBy(*signal.keys).agg(F.count("*").alias("pred_count"), F.count_if(s2).alias("s2_pred_count"), F.count_if(s3).alias("s3_pred_count"))
    left = filled(s1, signal.fields).select(F.col("entity_id").alias("s1_id"), *signal.keys)
    predicted = left.join(by_key, signal.keys).select("s1_id", "pred_count", "s2_pred_count", "s3_pred_count")
    ends = truth.select(F.col("source1_entity_id").alias("s1_id"), F.col("target_entity_id").alias("target_id"), "target_source")
    right = filled(targets, signal.fields).select(F.col("entity_id").alias("target_id"), *[F.col(k).alias(f"t_{k}") for k in signal.keys])
    both = ends.join(left, "s1_id").join(right, "target_id")
    for k in signal.keys:
        both = both.where(F.col(k) == F.col(f"t_{k}"))
    hits = both.groupBy("s1_id").agg(
        F.count("*").alias("tp_count"), F.count_if(F.col("target_source") == "S2").alias("s2_tp_count"), F.count_if(F.col("target_source") == "S3").alias("s3_tp_count")
    )
    return predicted.join(hits, "s1_id", "left").na.fill(0).select("s1_id", *COUNTS)


def counts_of_signals(wanted: list[Signal], s1: DataFrame, targets: DataFrame, truth: DataFrame) -> DataFrame:
    """signal, s1_id and counts of many signals at once: each table is read once, and the keys of
    all signals go through one aggregation and one join. As in an equi-join, a null key (a null
    country too) matches nothing."""

    def full(signal: Signal) -> Column:
        return reduce(and_, [*[F.col(f) != "" for f in signal.fields], *[F.col(k).isNotNull() for k in signal.keys]])

    def keyed(df: DataFrame, *columns: Column) -> DataFrame:
        keys = [F.when(full(s), F.struct(F.lit(s.key).alias("signal"), F.array(*s.keys).alias("value"))) for s in wanted]
        return df.select(*columns, F.explode(F.filter(F.array(*keys), lambda x: x.isNotNull())).alias("k")).select("*", "k.signal", "k.value").drop("k")

    source = F.col("source")
    by_key = keyed(targets, source).groupBy("signal", "value").agg(F.count("*").alias("pred_count"), F.count_if(source == "S2").alias("s2_pred_count"), F.count_if(source == "S3").alias("s3_pred_count"))
    predicted = keyed(s1, F.col("entity_id").alias("s1_id")).join(by_key, ["signal", "value"]).drop("value")
    fields = sorted({k for s in wanted for k in s.keys})
    left = s1.select(F.col("entity_id").alias("source1_entity_id"), *fields)
    right = targets.select(F.col("entity_id").alias("target_entity_id"), *[F.col(f).alias(f"t_{f}") for f in fields])
    both = truth.join(left, "source1_entity_id").join(right, "target_entity_id")
    agreeing = [F.when(full(s) & reduce(and_, [F.col(k) == F.col(f"t_{k}") for k in s.keys]), F.lit(s.key)) for s in wanted]
    hits = both.select(F.col("source1_entity_id").alias("s1_id"), "target_source", F.explode(F.filter(F.array(*agreeing), lambda x: x.isNotNull())).alias("signal")).groupBy("signal", "s1_id").agg(
        F.count("*").alias("tp_count"), F.count_if(F.col("target_source") == "S2").alias("s2_tp_count"), F.count_if(F.col("target_source") == "S3").alias("s3_tp_count")
    )
    return predicted.join(hits, ["signal", "s1_id"], "left").na.fill(0).select("signal", "s1_id", *COUNTS)


def per_entity(summary: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts and F0.5 of every S1 record of the summary, those without candidates too; by signal
    if both tables have that column."""
    by = ["signal"] if "signal" in counts.columns else []
    joined = summary.join(counts.withColumnRenamed("s1_id", "source1_entity_id"), [*by, "source1_entity_id"], "left").na.fill(0, COUNTS)
    rows = joined.withColumnRenamed("match_count", "gt_count").withColumns({
        "fp_count": F.col("pred_count") - F.col("tp_count"), "fn_count": F.col("gt_count") - F.col("tp_count"),
    })
    return rows.select(
        *by, "source1_entity_id", "country", "gt_count", "is_singleton", *COUNTS, "fp_count", "fn_count",
        entity_f05(F.col("gt_count"), F.col("pred_count"), F.col("tp_count")).alias("f05"),
    )


def _sum(c: str) -> Column:
    return F.coalesce(F.sum(c), F.lit(0))


def panel(rows: DataFrame, targets: int | Column, by: str | None = None, **constants: str) -> DataFrame:
    """One row of metrics of a per-entity table, or one for each value of `by`."""
    lone = F.col("is_singleton")
    of = lambda which, name: [
        F.coalesce(F.avg(F.when(which, F.col("f05"))), F.lit(0.0)).alias(f"{name}_f05"),
        F.coalesce(F.sum(F.when(which, F.col("tp_count"))), F.lit(0)).alias(f"{name}_tp"),
        F.coalesce(F.sum(F.when(which, F.col("pred_count"))), F.lit(0)).alias(f"{name}_pred"),
        F.coalesce(F.sum(F.when(which, F.col("gt_count"))), F.lit(0)).alias(f"{name}_gt"),
    ]
    s = (rows.groupBy(by) if by else rows).agg(
        F.count("*").alias("total_s1"), _sum("gt_count").alias("total_gt"), _sum("pred_count").alias("total_cand"), _sum("tp_count").alias("total_tp"),
        _sum("fp_count").alias("total_fp"), _sum("fn_count").alias("total_fn"), F.avg("f05").alias("macro_f05"), F.avg("pred_count").alias("avg_cand"),
        F.median("pred_count").alias("median_cand"), F.percentile("pred_count", 0.95).alias("p95_cand"), F.max("pred_count").alias("max_cand"),
        F.count_if(F.col("pred_count") == 0).alias("unresolved_s1"), F.count_if(lone & (F.col("pred_count") == 0)).alias("correct_sing"),
        F.count_if(lone & (F.col("pred_count") > 0)).alias("fp_sing"), F.count_if(lone).alias("total_sing"),
        *[_sum(f"{k}_{what}_count").alias(f"{k}_{what}") for k in ("s2", "s3") for what in ("pred", "tp")],
        *of(F.col("gt_count") == 0, "m0"), *of(F.col("gt_count") == 1, "m1"), *of(F.col("gt_count") > 1, "mm"),
    )
    goal = targets if isinstance(targets, Column) else F.lit(targets)
    s = s.withColumns({"pair_prec": ratio(F.col("total_tp"), F.col("total_cand")), "pair_rec": ratio(F.col("total_tp"), F.col("total_gt"))})
    out = {
        "macro_f05": F.col("macro_f05"), "pair_prec": F.col("pair_prec"), "pair_rec": F.col("pair_rec"), "pair_f05": f_beta(F.col("pair_prec"), F.col("pair_rec")),
        "cand_rec": F.col("pair_rec"), "reduction_ratio": reduction_ratio(F.col("total_cand"), F.col("total_s1"), goal),
        **{c: F.col(c) for c in ("total_s1", "total_cand", "total_tp", "total_fp", "total_fn", "avg_cand", "median_cand", "p95_cand", "max_cand", "unresolved_s1")},
        "unresolved_pct": 100.0 * ratio(F.col("unresolved_s1"), F.col("total_s1")), "correct_sing": F.col("correct_sing"), "fp_sing": F.col("fp_sing"),
        "sing_fpr": 100.0 * ratio(F.col("fp_sing"), F.col("total_sing")), "m0_f05": F.col("m0_f05"),
        **{f"{m}_{k}": v for m in ("m1", "mm") for k, v in {"f05": F.col(f"{m}_f05"), "prec": ratio(F.col(f"{m}_tp"), F.col(f"{m}_pred")), "rec": ratio(F.col(f"{m}_tp"), F.col(f"{m}_gt"))}.items()},
        **{f"{k}_prec": ratio(F.col(f"{k}_tp"), F.col(f"{k}_pred")) for k in ("s2", "s3")},
    }
    return s.select(*[F.lit(v).alias(k) for k, v in constants.items()], *([by] if by else []), *[v.alias(k) for k, v in out.items()])


def breakdown(rows: DataFrame, by: Column, name: str) -> DataFrame:
    """Entities, mean F0.5, precision and recall by a class, in one pass."""
    sums = rows.groupBy(by.alias(name)).agg(F.count("*").alias("entities"), F.avg("f05").alias("f05"), F.sum("tp_count").alias("tp"), F.sum("pred_count").alias("pred"), F.sum("gt_count").alias("gt"))
    return sums.select(name, "entities", "f05", ratio(F.col("tp"), F.col("pred")).alias("prec"), ratio(F.col("tp"), F.col("gt")).alias("rec"))


def match_class(count: Column) -> Column:
    return F.when(count == 0, "0").when(count == 1, "1").otherwise("2+")


def by_target_source(labeled: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision and recall by the source of the target."""
    found = labeled.groupBy("target_source").agg(F.count("*").alias("pred"), F.count_if("is_tp").alias("tp"))
    wanted = truth.groupBy("target_source").agg(F.count("*").alias("gt"))
    both = wanted.join(found, "target_source", "full").na.fill(0, ["pred", "tp", "gt"])
    return both.select("target_source", "pred", "tp", "gt", ratio(F.col("tp"), F.col("pred")).alias("prec"), ratio(F.col("tp"), F.col("gt")).alias("rec"))
