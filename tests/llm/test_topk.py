import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import queries as Q
from tessera.llm import topk


def brute(rows, k, is_query):
    """All pairs of rows with different ids; the results of an id's query rows are ranked together."""
    table = [(i, tuple(math.floor(1024 * float(np.float32(x))) for x in v)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    scores = {}
    for q, a in table:
        if is_query(q):
            scores.setdefault(q, []).extend((-sum(x * y for x, y in zip(a, b)), i) for i, b in table if i != q)
    return sorted((q, rank, i, -s) for q, found in scores.items() for rank, (s, i) in enumerate(sorted(found)[:k], 1))


def test_query(same_as_sql):
    same_as_sql(Q.QUERIES["op3_pivot_distance"], Q.SQL["op3_pivot_distance"])


@pytest.mark.parametrize("block_rows,pivots,rings,blocks_per_key", [(7, 3, 4, 64), (5, 20, 48, 2), (2048, None, None, 64)])
def test_against_brute_force(spark, block_rows, pivots, rings, blocks_per_key):
    draw = np.random.default_rng(block_rows)
    centres = draw.normal(0, 1, (5, 6))
    rows = [(i, (centres[i % 5] + draw.normal(0, 0.2, 6)).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, [0.5] * 6) for i in range(60)]  # one common vector: ties
    rows += [(600 + i, (draw.normal(0, 40 * (i + 1), 6)).astype(np.float32).tolist()) for i in range(30)]  # outliers
    rows += [rows[3], rows[3], (400, None), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (402, [float("nan")] * 6), (403, [float("inf")] * 6), (404, []), (None, [1.0] * 6), (405, [0.25, -0.5])]
    table = spark.createDataFrame([(i, v, "x", 3) for i, v in rows], "vec_id long, embedding array<float>, id string, score int")
    got = topk.search(table, F.col("id") % 20 == 0, 10, block_rows=block_rows, pivots=pivots, rings=rings, blocks_per_key=blocks_per_key, sample_rows=50)
    assert sorted(map(tuple, got.collect())) == brute(rows, 10, lambda i: i % 20 == 0)


def test_repeated_rows_and_ids(spark, tmp_path):
    """As the SQL has them: equal rows, rows of one id with other vectors, queries among both."""
    import duckdb

    draw = np.random.default_rng(4)
    rows = [(int(i), draw.normal(0, 1, 4).astype(np.float32).tolist()) for i in draw.integers(0, 250, 400)]
    rows += [rows[5]] * 30 + [(100, [1.0, 2.0, 0.5, 0.0])] * 3 + [(100, [-1.0, 0.0, 0.5, 3.0])] + [(200, [0.0] * 4)] + [(7, [9.0, 9.0, 9.0, 9.0])] * 15
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(map(tuple, Q.QUERIES["op3_pivot_distance"](spark, str(tmp_path)).collect()))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    assert got == sorted(db.execute(Q.SQL["op3_pivot_distance"]).fetchall()) == brute(rows, 10, lambda i: i % 100 == 0)


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [2.0, 1.0])], schema)
    assert sorted(map(tuple, topk.search(few, F.col("id") == 0, 10).collect())) == [(0, 1, 1, 4 * 1024 * 1024), (0, 2, 2, 4 * 1024 * 1024)]
    assert topk.search(few, F.col("id") == 7, 10).count() == 0
    assert topk.search(few.limit(0), F.col("id") == 0, 10).count() == 0
    assert topk.search(few.where("vec_id = 0"), F.col("id") == 0, 10).count() == 0


def test_annuli_are_neighbouring_blocks_of_bounded_number(spark):
    """Also where one vector is most rows; a ring's annuli follow each other in distance."""
    draw = np.random.default_rng(9)
    rows = [(i, draw.normal(0, 1, 4).tolist() if i % 3 else [0.5] * 4) for i in range(900)]
    vectors = topk.integers(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")
    tables = []
    index, _ = topk.build(vectors, block_rows=10, blocks_per_key=3, pivots=4, rings=4, into=tables)
    got = index.groupBy("annulus").agg(F.count("*").alias("blocks"), F.count_distinct("pivot", "ring").alias("keys"), F.min("low").alias("low"), F.max("high").alias("high"), F.first("pivot").alias("pivot"), F.sum("n").alias("n")).orderBy("annulus").collect()
    assert sum(r["n"] for r in got) == 900 and max(r["blocks"] for r in got) == 3 and all(r["keys"] == 1 for r in got)
    for a, b in zip(got, got[1:]):
        assert (a["pivot"], a["high"]) <= (b["pivot"], b["low"])
    topk.discard(spark, tables)


def test_grid_follows_the_rows():
    assert topk.grid(1000) == (16, 8)
    assert topk.grid(10**9) == (64, 48) and topk.grid(10**7) == (64, 8)
    assert topk.grid(10**8) == (64, 11)


def test_large_integers():
    a, b = np.array([[2.0**30, 1.0]]), np.array([[2.0**30, 3.0]])
    assert topk._products(a, b).tolist() == [[2**60 + 3]]
