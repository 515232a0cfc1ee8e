import hashlib
import random
import re

import pytest

from tessera.llm import decontaminate as D
from tessera.llm import queries as Q

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        if item is not None:
            for k in range(max(1, len(w) - 9) if w else 0):
                windows.setdefault(tuple(w[k : k + 10]), set()).add(str(item))
    out = {}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if got := windows.get(tuple(w[k : k + n])):
                    found |= got
                    hit |= set(range(k, k + n))
        out[doc] = len(w), len(hit), sorted(found)
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_against_brute_force(spark, frame, block_bytes):
    random.seed(block_bytes)
    vocabulary = ["a", "b", "C", "dé", "x1"]
    text = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    items = [(i, text(random.choice([0, 1, 2, 5, 9, 10, 11, 30]))) for i in range(20)] + [(None, "a b"), (3, text(12)), (30, None), (31, "...")]
    docs = [(i, random.choice([text(40), text(3), items[i % 20][1] + ", " + text(5), text(8) + "\n" + items[i % 20][1].upper()])) for i in range(60)]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["hit_items"]) for r in D.scan(frame(docs), benchmark, block_bytes=block_bytes).collect()}
    assert got == brute(docs, items)


def test_edges(spark, edge):
    benchmark = spark.createDataFrame([(1, "same text here for ties and more")], "item_id long, text string")
    rows = D.scan(edge, benchmark).collect()
    assert len(rows) == 13
    hits = {r["doc_id"]: r["n_hit"] for r in rows if r["doc_id"] is not None}
    assert hits[5] == hits[6] == 7 and hits[1] == hits[2] == hits[3] == 0
    assert [s.asDict() for s in next(r for r in rows if r["doc_id"] == 5)["hit_spans"]] == [{"start": 0, "end": 7}]
    clean = D.clean(edge, benchmark)
    assert clean.columns == edge.columns and clean.count() == 11 and clean.first()["n_hit"] == "h"


def test_empty(spark, frame):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert D.scan(frame([]), benchmark).count() == 0
    assert [r["n_hit"] for r in D.scan(frame([(1, "a b")]), benchmark).collect()] == [0]


def test_query(same_as_sql):
    same_as_sql(Q.QUERIES["op8_winnowing"], Q.SQL["op8_winnowing"])


def test_no_items_digest(spark, sf_dir):
    rows = Q.QUERIES["op8_winnowing"](spark, sf_dir).where("n_items = 0").collect()
    assert {r["items_sha256"] for r in rows} == {hashlib.sha256(b"").hexdigest()}


def test_repetitive_texts(frame, spark, monkeypatch):
    """Of one word, of a few in turn, against items as repetitive: right, and in bounded parts."""
    monkeypatch.setattr(D, "PAIRS", 50)
    docs = [(1, "a " * 700), (2, "a b " * 300), (3, "x " + "a " * 9), (4, "a " * 9), (5, "a b c " * 100 + "q " + "a " * 30), (6, "b " * 4)]
    items = [("i", "a " * 200), ("j", "b a " * 40), ("k", "a " * 10), ("l", "b " * 3), ("m", "a b c " * 50), ("n", "a " * 200)]
    found = D.scan(frame(docs), spark.createDataFrame(items, "item_id string, text string"), keep=["doc_id"]).collect()
    want = brute(docs, items)
    assert {r["doc_id"]: (r["n_words"], r["n_hit"], set(r["hit_items"])) for r in found} == {k: (w, h, set(i)) for k, (w, h, i) in want.items()}


def test_long_repetitive_text_in_bounded_memory():
    import subprocess
    import sys

    code = """
import resource, pyarrow as pa
from tessera.llm import decontaminate as D, words as W
from tessera.llm.common import utf8_buffers
index = D.ItemIndex(["x"], ["a " * 200])
words, at = W.text_words(*utf8_buffers(pa.array(["a " * 5_000_000])))
flags, pairs = index.hits(words, at)
assert flags.all() and pairs.tolist() == [0]
print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=str(__import__("pathlib").Path(__file__).parents[2]))
    assert int(out.stdout) < 1_000_000  # kilobytes
