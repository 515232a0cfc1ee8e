"""The twelve exact-match signals: which keys a record and a target must share."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Signal:
    key: str
    fields: tuple[str, ...]
    blocked: bool

    @property
    def keys(self) -> list[str]:
        return [*(["country"] if self.blocked else []), *self.fields]


_PLAIN = {
    "raw_name": ("business_name",),
    "norm_name": ("norm_name",),
    "raw_addr": ("business_address",),
    "norm_addr": ("norm_addr",),
    "norm_name_and_addr": ("norm_name", "norm_addr"),
}
_LEGAL = {"legal_norm_name": ("norm_name_legal",), "legal_norm_name_and_addr": ("norm_name_legal", "norm_addr")}
SIGNALS = {s.key: s for s in [
    *[Signal(k, f, False) for k, f in _PLAIN.items()],
    *[Signal(f"country_{k}", f, True) for k, f in {**_PLAIN, **_LEGAL}.items()],
]}


def filled(df: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Rows whose fields are all non-empty: blanks never match."""
    for field in fields:
        df = df.where(F.col(field) != "")
    return df


def candidates(signal: Signal, s1: DataFrame, targets: DataFrame) -> DataFrame:
    """s1_id, target_id and target_source of all pairs that share the signal's keys."""
    left = filled(s1, signal.fields).select(F.col("entity_id").alias("s1_id"), *signal.keys)
    right = filled(targets, signal.fields).select(F.col("entity_id").alias("target_id"), F.col("source").alias("target_source"), *signal.keys)
    return left.join(right, signal.keys).select("s1_id", "target_id", "target_source")


def without_heavy_keys(left: DataFrame, right: DataFrame, field: str, limit: int = 100_000) -> tuple[DataFrame, DataFrame]:
    """Both sides without the keys that more than `limit` rows of the right side have."""
    heavy = right.groupBy(field).count().where(F.col("count") > limit).select(field)
    return left.join(heavy, field, "left_anti"), right.join(heavy, field, "left_anti")
