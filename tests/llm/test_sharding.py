import zlib
from collections import Counter

from pyspark.sql import functions as F

from tessera.llm import queries as Q
from tessera.llm import sharding as S


def test_query(same_as_sql):
    same_as_sql(Q.QUERIES["op9_rendezvous"], Q.SQL["op9_rendezvous"])


def test_growth_moves_rows_into_the_new_shard_only(spark):
    keys = spark.range(20_000).select(F.col("id").cast("string").alias("k"))
    rows = keys.select(S.assign(F.col("k"), [1.0] * 6).alias("a"), S.assign(F.col("k"), [1.0] * 7).alias("b")).collect()
    assert all(r["a"] == r["b"] or r["b"] == 6 for r in rows)
    moved = sum(r["b"] == 6 for r in rows) / len(rows)
    assert abs(moved - 1 / 7) < 0.01


def test_weights(spark):
    rows = spark.range(30_000).select(S.assign(F.col("id").cast("string"), [1.0, 2.0, 3.0]).alias("s")).groupBy("s").count().collect()
    share = {r["s"]: r["count"] / 30_000 for r in rows}
    assert all(abs(share[k] - (k + 1) / 6) < 0.015 for k in range(3))


def test_edges(edge):
    rows = S.shard(edge, [1.0] * 4, rows_per_range=1).collect()
    assert len(rows) == 13
    for shard in {r["shard"] for r in rows}:
        assert sorted(r["slot"] for r in rows if r["shard"] == shard) == list(range(sum(r["shard"] == shard for r in rows)))
    for r in rows:
        if r["doc_id"] in (1, 2):
            assert (r["size"], r["text_crc32"]) == (8, 0)
    assert next(r for r in rows if r["doc_id"] == 9)["text_crc32"] == zlib.crc32("ünï çödé ñ 日本語 текст".encode())
    assert len({r["shard"] for r in rows if r["doc_id"] == 7}) == 1
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1


def test_slots_do_not_depend_on_the_ranges(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    a, b = (sorted(map(tuple, S.shard(docs, [1.0] * 3, rows_per_range=n).collect())) for n in (1, 10_000))
    assert a == b
    assert len(Counter(r[3] for r in a)) == 3


def test_empty(frame):
    assert S.shard(frame([]), [1.0, 1.0]).count() == 0


def test_hot_keys(frame):
    """A key with most rows: gapless slots, in the order of keys, without one task for it."""
    import hashlib

    rows = [(7, f"t{i}") for i in range(3000)] + [(None, "n")] * 500 + [(i, "x") for i in range(2000)]
    out = S.shard(frame(rows), [1.0] * 3, rows_per_range=10).collect()
    assert len(out) == len(rows)
    for s in range(3):
        mine = sorted((r["slot"], r["doc_id"]) for r in out if r["shard"] == s)
        assert [slot for slot, _ in mine] == list(range(len(mine)))
        order = [hashlib.md5(("" if k is None else str(k)).encode()).hexdigest()[:13] for _, k in mine]
        assert order == sorted(order)
