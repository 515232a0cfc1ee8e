import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing as P
from tessera.llm import queries as Q


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(Q.tokenizer_path())


def check(rows, texts, tokenizer, window):
    """Each id lies in one piece, pieces fill their sequences gaplessly; texts: (id, text) rows."""
    by_sequence, pieces = defaultdict(list), defaultdict(list)
    for r in rows:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        pieces[r["doc_id"]].append(r)
    for spans in by_sequence.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end and length > 0
            end += length
        assert end <= window
    for key, text in texts:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, P.END_ID]
        own = sorted(pieces[key], key=lambda r: r["start"])
        assert [r["doc_tokens"] for r in own] == [len(ids)] * len(own)
        assert [i for r in own for i in np.frombuffer(r["ids"], "<u4").tolist()] == ids
        assert [r["start"] for r in own] == [sum(x["length"] for x in own[:k]) for k in range(len(own))]
    return by_sequence


def test_table(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = P.pack(docs, Q.tokenizer_path()).collect()
    sequences = check(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], tokenizer, P.WINDOW)
    partial = [s for s in sequences.values() if sum(n for _, n in s) < P.WINDOW]
    assert len(partial) <= docs.rdd.getNumPartitions()
    query = {(r["doc_id"], r["start"]): r for r in Q.QUERIES["op10_sum_of_squares"](spark, sf_dir).collect()}
    assert len(query) == len(rows)
    for r in rows:
        assert query[r["doc_id"], r["start"]]["ids_crc32"] == zlib.crc32(r["ids"])


def test_edges(edge, tokenizer):
    rows = P.pack(edge.coalesce(1), Q.tokenizer_path(), window=64).collect()
    kept = [(r["doc_id"], r["text"]) for r in edge.collect() if r["doc_id"] not in (7, None)]
    check(rows, kept, tokenizer, 64)
    assert sum(r["start"] == 0 for r in rows) == 13
    assert [r["length"] for r in rows if r["doc_id"] in (1, 2)] == [1, 1]


def test_empty(frame):
    assert P.pack(frame([]), Q.tokenizer_path()).count() == 0


def test_place_minimises_the_sum_of_squares():
    """Against a plain search over all levels."""
    random.seed(3)
    packer, counts = P.Packer(12, 0), [0] * 13

    def squares(c):
        return sum(x * x for x in c[1:12])

    for _ in range(3000):
        size = random.randint(1, 11)
        best = None
        for level in range(13 - size):
            if level == 0 or counts[level]:
                after = counts.copy()
                after[level] -= level > 0
                after[level + size] += level + size < 12
                cost = squares(after)
                if best is None or cost <= best[0]:
                    if best is None or cost < best[0] or level > 0:
                        best = cost, level
        _, level = packer.place(size)
        after = counts.copy()
        after[level] -= level > 0
        after[level + size] += level + size < 12
        assert squares(after) == best[0]
        counts = after
        assert list(packer.count) == counts


def test_encoders_agree(tokenizer, monkeypatch):
    random.seed(5)
    letters = "abc ABC  12'\n\t.,é日<|endoftext|> 😀"
    for _ in range(300):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 60)))
        tokenizer.encode_special_tokens = True
        assert P.encode(Q.tokenizer_path(), text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    whole = "".join(random.choice(letters) for _ in range(20_000))
    monkeypatch.setattr(P, "PART", 50)
    assert P.encode(Q.tokenizer_path(), whole).tolist() == tokenizer.encode(whole, add_special_tokens=False).ids
    monkeypatch.setattr(P, "LONG_TEXT", 60)
    assert P.encode(Q.tokenizer_path(), whole).tolist() == tokenizer.encode(whole, add_special_tokens=False).ids
    monkeypatch.undo()
    long = "x" * 1000 + " y" * (600_000)
    assert P.encode(Q.tokenizer_path(), long).tolist() == tokenizer.encode(long, add_special_tokens=False).ids


def test_added_tokens_in_texts(frame, monkeypatch):
    """As tokenizers encodes them with its own defaults."""
    own = Tokenizer.from_file(Q.tokenizer_path())
    assert P.encode(Q.tokenizer_path(), "hello <|endoftext|> x").tolist() == [31373, 220, 50256, 2124]
    random.seed(8)
    words = ["<|endoftext|>", "<|endof", "text|>", " ", "  ", "\n", "a", " b", "12", "é", "日", "<|", "|>"]
    texts = ["".join(random.choice(words) for _ in range(random.randint(0, 40))) for _ in range(300)]
    for text in texts:
        assert P.encode(Q.tokenizer_path(), text).tolist() == own.encode(text, add_special_tokens=False).ids
    rows = list(enumerate(texts))
    check(P.pack(frame(rows), Q.tokenizer_path(), window=64).collect(), rows, own, 64)
    whole = "".join(random.choice(words) for _ in range(20_000))
    monkeypatch.setattr(P, "PART", 50)
    monkeypatch.setattr(P, "LONG_TEXT", 60)
    assert P.encode(Q.tokenizer_path(), whole).tolist() == own.encode(whole, add_special_tokens=False).ids
