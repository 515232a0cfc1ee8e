import random
import zlib

import numpy as np
import pytest

from tessera.llm import quality as Q
from tessera.llm import queries


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    rows = {r["doc_id"]: r for r in queries.QUERIES["op1_bradley_terry"](spark, sf).collect()}
    labels = [r for r in spark.read.parquet(f"{sf}/labels.parquet").collect() if rows[r["doc_id"]]["held_out"]]
    assert all(rows[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in labels)
    right = sum(rows[r["doc_id"]]["predicted"] == r["quality"] for r in labels) / len(labels)
    assert right >= 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())


def test_held_out_labels_are_not_used(spark, sf_dir, tmp_path):
    """Flipping them changes no score."""
    from pyspark.sql import functions as F

    from tessera.llm.common import text_crc

    path = str(tmp_path)
    spark.read.parquet(f"{sf_dir}/documents.parquet").write.parquet(f"{path}/documents.parquet")
    held = F.pmod(text_crc("doc_id"), F.lit(3)) == 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality"))).write.parquet(f"{path}/labels.parquet")
    a, b = (sorted((r["doc_id"], round(r["score"], 9)) for r in queries.QUERIES["op1_bradley_terry"](spark, p).collect()) for p in (sf_dir, path))
    assert a == b


def test_ranking_separates(spark):
    draw = np.random.default_rng(0)
    x = lambda shift, n: np.column_stack([draw.normal(shift, 1, (n, 4)), draw.normal(0, 1, (n, 20)), np.ones((n, 1))])
    good, bad = x(2, 400), x(-2, 80)
    model = Q.bradley_terry(good, bad)
    assert (model.score(x(2, 500)) >= 0.5).mean() > 0.95 and (model.score(x(-2, 500)) < 0.5).mean() > 0.95
    # the cut is the score quantile at the share of bad rows
    assert (np.concatenate([model.score(good), model.score(bad)]) < 0.5).sum() == 80


def test_features_of_pieces():
    text = b"some words here, and more.\n" * 50
    data = np.frombuffer(text, np.uint8)
    one = Q.features(data, np.array([0, len(data)]))
    many = Q.features(np.concatenate([data, data]), np.array([0, len(data), len(data), 2 * len(data)]))
    assert np.allclose(one[0], many[0]) and np.allclose(many[0], many[2]) and not many[1].any()


@pytest.mark.parametrize("piece", [1, 2, 7, 1000, 4999])
def test_long_texts_have_the_same_features(monkeypatch, piece):
    random.seed(3)
    data = np.frombuffer("".join(random.choice("aAbé  \n\n..,,!!日Z") for _ in range(5000)).encode(), np.uint8)
    want = Q.features(data, np.array([0, len(data)]))
    monkeypatch.setattr(Q, "_PIECE", piece)
    assert np.array_equal(Q.features(data, np.array([0, len(data)])), want)


def test_features_do_not_depend_on_neighbours():
    texts = [b"!abc", b"...", b"..", b"Zz", b"  a", b" "]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    alone = [Q.features(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0] for t in texts]
    assert np.array_equal(Q.features(data, offsets), np.array(alone))


def test_query_against_plain_newton(spark, sf_dir):
    """Scores from pair differences, the logistic loss's own stationary point and the quantile, all anew."""
    rows = {r["doc_id"]: r for r in queries.QUERIES["op1_bradley_terry"](spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    one = lambda t: Q.features(x := np.frombuffer(t.encode(), np.uint8), np.array([0, len(x)]))[0]
    taught = sorted({(r["quality"], one(texts[r["doc_id"]]).tobytes()) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1})
    good, bad = (np.array([np.frombuffer(x) for q, x in taught if (q > 0) == kind]) for kind in (True, False))
    mean = np.concatenate([good, bad])[:, :-1].mean(0)
    centre = lambda x: (x[:, :-1] - mean) * x[:, -1:]
    both = centre(np.concatenate([good, bad]))
    scale = np.array([1 / max(s, 1e-3) if s > 0 else 0 for s in both.std(0)])
    draw = np.random.default_rng(1)
    n = min(Q.MAX_PAIRS, 4 * len(good) * len(bad))
    difference = (centre(good)[draw.integers(len(good), size=n)] - centre(bad)[draw.integers(len(bad), size=n)]) * scale
    w = np.zeros(difference.shape[1])
    for _ in range(60):  # sum over pairs of log(1 + exp(-w.x)), with w.w / 2 added
        p = 1 / (1 + np.exp(-difference @ w))
        gradient = -(difference * (1 - p)[:, None]).sum(0) + w
        curvature = (difference.T * (p * (1 - p))) @ difference + np.eye(len(w))
        w -= np.linalg.solve(curvature, gradient)
    assert np.abs(-(difference * (1 - 1 / (1 + np.exp(-difference @ w)))[:, None]).sum(0) + w).max() < 1e-6
    ranks = sorted(both @ (w * scale))
    cut = (ranks[len(bad) - 1] + ranks[len(bad)]) / 2
    for key, text in texts.items():
        x = one(text)
        want = 1 / (1 + np.exp(-np.clip((x[:-1] - mean) * x[-1] @ (w * scale) - cut, -30, 30)))
        assert abs(rows[key]["score"] - want) < 1e-3


def test_edges(spark, frame, edge):
    random.seed(1)
    word = lambda: random.choice(["alpha", "beta", "gamma", "delta", "of", "the"])
    good = [(100 + i, " ".join(word() for _ in range(60)).capitalize() + ".") for i in range(40)]
    bad = [(200 + i, "###".join(word() for _ in range(60)) + "!!") for i in range(40)]
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(None, 1), (100, None), (999, 0)], "doc_id long, quality int")
    docs = frame(good + bad)
    model = Q.fit(docs, labels)
    rows = Q.score(edge, model).collect()
    assert len(rows) == 13 and all(0 <= r["score"] <= 1 for r in rows)
    by_id = {r["doc_id"]: r["score"] for r in rows}
    assert by_id[1] == by_id[2] and by_id[5] == by_id[6]
    kept = Q.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {i for i, _ in good}
    assert Q.fit(docs, labels.limit(0)) is None and Q.fit(docs, labels.where("quality = 1")) is None
    assert Q.keep_good(docs, labels.limit(0)).count() == 80
    assert Q.score(frame([]), model).count() == 0
