"""Reports: the audits and panels as Markdown, CSV and JSON files."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessera.plans.queries import queries
from tessera.sources import sinks

SECTIONS = {
    "Sources": ["source_stats", "country_dist", "length_stats"],
    "Ground truth": ["match_classes", "match_count_dist", "s2_s3_overlap", "gt_counts"],
    "Matched pairs": ["exact_rates", "missing_asymmetry", "script_mismatch", "name_variations", "address_variations"],
    "Candidates": ["metrics_panel", "by_match_class", "by_country", "by_target_source", "union_recall", "addr_incompat"],
    "Retrieval": ["recall_panel"],
}


def markdown(spark: SparkSession, sf_dir: str, sections: dict[str, list[str]] = SECTIONS) -> str:
    """All sections as one Markdown text; each table is a small report, sorted by its first columns."""
    plans = queries()
    lines = ["# Audit\n"]
    for title, names in sections.items():
        lines.append(f"## {title}\n")
        for name in names:
            table = plans[name](spark, sf_dir)
            lines += [f"### {name}\n", sinks.markdown_table(table.orderBy(*table.columns[:3]))]
    return "\n".join(lines)


def write(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """audit (Markdown), metrics (CSV, all columns), candidate_statistics (CSV, some) and
    hard_negatives (JSON) below a folder."""
    plans = queries()
    spark.createDataFrame([(markdown(spark, sf_dir),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/audit")
    metrics = plans["metrics_panel"](spark, sf_dir)
    sinks.write_csv(metrics, f"{folder}/metrics")
    sinks.write_csv(metrics, f"{folder}/candidate_statistics", ["split", "key", "total_cand", "avg_cand", "median_cand", "p95_cand", "max_cand", "unresolved_s1", "reduction_ratio"])
    sinks.write_json(plans["hard_negatives"](spark, sf_dir), f"{folder}/hard_negatives")
