"""Rendezvous hashing of stable record keys over weighted shards, in DataFrame functions only.

Shard s of weight w gets the record when -ln(u) / w is least, where u in (0, 1) is read off
md5(key:s). The key and the weights alone decide, so one more shard takes rows into itself
and moves no other row. Within its shard a record's slot is its rank by md5(key).

The slots need no task that sees a whole shard: records fall into ranges of md5(key) of about
`rows_per_range` rows, ranks are taken within (shard, range), and a running total over the
counts of ranges, a small table, is added. A range of many times as many rows holds a hot key;
there each key is a range of its own, dealt over as many parts as its rows need.

Null keys are one key, the empty text; rows with equal keys share a shard and take
neighbouring slots in any order. An empty table gives an empty result. The result has columns of its own, whatever else the records carry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import discard, stored

#: 13 hex digits of md5: the integers that a double holds exactly.
_HEX, _RANGE = 13, 1 << 52
ROWS_PER_RANGE = 1024
#: A range with this many times ROWS_PER_RANGE rows is a hot one.
HOT = 16


def _hash(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, _HEX), 16, 10).cast("long")


def _cost(key: Column, shard: Column, weight: Column) -> Column:
    u = (_hash(F.concat(key, F.lit(":"), shard.cast("string"))).cast("double") + 0.5) / float(_RANGE)
    return -F.log(u) / weight


def _costs(key: Column, weights: list[float]) -> Column:
    """(cost, shard) of every shard, each hashed once."""
    table = F.array(*[F.lit(float(w)) for w in weights])
    return F.transform(
        F.sequence(F.lit(0), F.lit(len(weights) - 1)),
        lambda s: F.struct(_cost(key, s, F.element_at(table, s + 1)).alias("cost"), s.alias("shard")),
    )


def assign(key: Column, weights: list[float]) -> Column:
    """The shard of a key (text): the one of least cost; of equal costs the first."""
    return F.array_min(_costs(key, weights))["shard"]


def assign_and_grow(key: Column, weights: list[float], new_weight: float) -> Column:
    """A struct of the shard, and the shard if there were one more."""
    costs = F.array(_costs(key, [*weights, new_weight]))  # named once, so that it is computed once
    both = lambda c: F.struct(F.array_min(F.slice(c, 1, len(weights)))["shard"].alias("shard"), F.array_min(c)["shard"].alias("grown_shard"))
    return F.transform(costs, both)[0]


def shard(docs: DataFrame, weights: list[float], *, key: str = "doc_id", text: str = "text",
          new_weight: float = 1.0, rows_per_range: int = ROWS_PER_RANGE) -> DataFrame:
    """key, size, text_crc32, shard, grown_shard (with one more shard) and slot of every record."""
    used: list[str] = []
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(
        F.col(key).alias("key"),
        (F.octet_length(body) + 8).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        assign_and_grow(name, weights, new_weight).alias("shards"),
        _hash(name).alias("h"),
    )
    keyed = keyed.select("key", "size", "text_crc32", "h", "shards.*", F.monotonically_increasing_id().alias("row"))
    keyed = stored(keyed, "sharding", into=used)  # the texts are read once; what follows reads some 50 bytes a row
    ranges = max(1, keyed.count() // (rows_per_range * len(weights)))
    keyed = keyed.withColumn("range", F.expr(f"h div {-(-_RANGE // ranges)}"))
    most = HOT * rows_per_range
    sizes = keyed.groupBy("shard", "range").agg(F.count("*").alias("n"))
    hot = sizes.where(F.col("n") > most).select("shard", "range", F.ceil(F.col("n") / most).alias("parts"))
    # the hot ranges are fewer than the rows by that factor; all others have one part and no key
    keyed = keyed.join(hot, ["shard", "range"], "left").withColumns({
        "at": F.when(F.col("parts").isNotNull(), F.col("h")).otherwise(F.lit(-1)),
        "part": F.when(F.col("parts").isNotNull(), F.pmod(F.xxhash64("row"), F.col("parts"))).otherwise(F.lit(0)),
    })
    group = ["shard", "range", "at", "part"]
    counts = keyed.groupBy(*group).agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("range", "at", "part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*group, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    ranked = keyed.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy("h", "key", "row")))
    out = stored(ranked.join(offsets, group).select(
        F.col("key").alias(key), "size", "text_crc32", "shard", "grown_shard", (F.col("offset") + F.col("rank") - 1).alias("slot")
    ), "shards")
    discard(docs.sparkSession, used)
    return out
