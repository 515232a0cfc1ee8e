import re

import __spark_entry__ as entry
import corpus_pipeline
import numpy as np
from test_decontaminate import brute as brute_hits
from test_neardup import brute as brute_classes
from test_packing import check as check_pieces
from tokenizers import Tokenizer

from tessera.llm import quality, queries
from tessera.llm.common import stored


def test_registered():
    names = list(entry.queries())
    for n in range(1, 11):
        assert sum(bool(re.match(rf"op{n}_", x)) for x in names) == 1
    assert "pipeline" in names and set(queries.SQL) <= set(queries.QUERIES)
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "near-duplicates", "decontamination", "pii", "packing"]


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def personal(texts):
    """Addresses, phone numbers, IPv4 addresses and valid cards, found plainly."""
    found = set()
    for t in texts:
        found |= set(re.findall(r"[\w.]+@[\w.]+\w", t)) | set(re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", t))
        found |= {m for m in re.findall(r"(?<!\d)\d{16}(?!\d)", t) if luhn(m)}
        found |= {m for m in re.findall(r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d])", t) if all(int(x) < 256 for x in m.split("."))}
    return found


def test_stages_against_brute_force(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    columns = docs.dtypes
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        start = docs
        docs = stored(stage(spark, docs, sf_dir), "test")
        rows = docs.collect()
        if name == "packing":
            break
        assert docs.dtypes == columns, name
        after = {r["doc_id"]: r["text"] for r in rows}
        assert len(after) == len(rows) and set(after) <= set(before)
        if name == "quality classifier":
            model = quality.fit(start, labels)
            one = lambda t: model.score(quality.features(x := np.frombuffer(t.encode(), np.uint8), np.array([0, len(x)])))[0]
            want = {i for i, t in before.items() if one(t) >= 0.5}
        elif name == "near-duplicates":
            want = {int(least) for _, least in brute_classes(list(before.items()))}
        elif name == "decontamination":
            items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
            want = {i for i, (_, hit, _) in brute_hits(list(before.items()), items).items() if not hit}
        else:
            want = set(before)
            assert all(r["n_chars"] == len(r["text"]) for r in rows)
            assert not personal(before.values()) & personal(after.values())
            untouched = [i for i, t in before.items() if not re.search(r"[0-9@]", t)]
            assert all(after[i] == before[i] for i in untouched)
        assert set(after) == want, name
        if name != "pii":
            assert all(after[i] == before[i] for i in after)
        before = after
    check_pieces(rows, list(before.items()), Tokenizer.from_file(queries.tokenizer_path()), 2048)
    assert {r["doc_id"] for r in rows} == set(before)
    whole = corpus_pipeline.run(spark, sf_dir)
    assert whole.columns == docs.columns and whole.count() == len(rows)


def test_empty_documents(spark, sf_dir, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_edge_rows_through_all_stages(spark, sf_dir, edge):
    """Null ids and texts, empty, very long and repeated texts, clashing columns, no n_chars."""
    before = [(r["doc_id"], r["text"]) for r in edge.collect()]
    docs = edge.drop("n_chars")
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        docs = stored(stage(spark, docs, sf_dir), "test")
        assert docs.columns == [c for c in edge.columns if c != "n_chars"], name
        assert {(r["doc_id"], r["text"]) for r in docs.collect()} <= set(before)
    kept = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(str(k) for k, _ in kept) == sorted(["1", "3", "4", "5", "7", "8", "9", "10", "None", "None"])
    pieces = corpus_pipeline.packed(spark, docs, sf_dir).collect()
    assert {p["doc_id"] for p in pieces} == {k for k, _ in kept} and sum(p["start"] == 0 for p in pieces) == len(kept)
