"""The tables as SQL views, for queries written as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.operators.split import stratified_split
from tessera.sources.tables import targets_of, truth_pairs, truth_summary

NAMES = ("s1_all", "s1_val", "targets", "gt_pairs", "gt_s1_all", "gt_s1_val")


def register(records: DataFrame, lists: DataFrame) -> SparkSession:
    """Views over normalized records (with `source`) and ground-truth lists: s1_all, s1_val,
    targets, gt_pairs, gt_s1_all and gt_s1_val. They are lazy; nothing is computed here."""
    s1 = targets_of(records, "S1")
    summary = stratified_split(truth_summary(lists, s1))
    flags = summary.select(summary.source1_entity_id.alias("entity_id"), "is_val")
    flagged = s1.join(flags, "entity_id", "left")
    tables = (flagged, flagged.where("is_val"), targets_of(records), truth_pairs(lists), summary, summary.where("is_val"))
    for name, table in zip(NAMES, tables, strict=True):
        table.createOrReplaceTempView(name)
    return records.sparkSession
