import random
import zlib

import numpy as np

from tessera.llm import langid as L
from tessera.llm import queries


def phrases(text, known):
    """Greedy longest phrases, plainly."""
    text, known = (bytes(L.fold(np.frombuffer(x, np.uint8))) for x in (text, known))
    at = count = 0
    while at < len(text):
        end = at + 1
        while end < len(text) and text[at : end + 1] in known:
            end += 1
        if text[at:end] not in known:
            end = at + 1
        at = end
        count += 1
    return count


def test_parse_against_brute_force(monkeypatch):
    random.seed(2)
    some = lambda letters, n: "".join(random.choice(letters) for _ in range(n)).encode()
    texts = {"a": [some("abc ", 300)], "b": [some("bcdé ", 300)]}
    parser = L.Parser(texts)
    documents = [some("abcdeé 1", random.choice([0, 1, 5, 80, 1024, 1025, 5000])) for _ in range(60)] + [b"a" * 4000, b"abc " * 1500]
    data = np.frombuffer(b"".join(documents), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(d) for d in documents])])
    want = [[phrases(document, b" ".join(texts[k])) for k in ("a", "b")] for document in documents]
    for step, checks in ((1024, [0, 32, 128, 1024]), (100, [0, 30, 100]), (7, [0, 3, 7])):  # whatever the pieces
        monkeypatch.setattr(L, "_STEP", step)
        monkeypatch.setattr(L, "_CHECKS", checks)
        assert parser.phrases(data, offsets).tolist() == want


def test_automaton_holds_all_substrings():
    random.seed(4)
    text = bytes(random.choice(b"ab") for _ in range(60))
    moves = L.suffix_automaton(text)

    def accepts(word):
        state = 0
        for byte in word:
            if byte not in moves[state]:
                return False
            state = moves[state][byte]
        return True

    for _ in range(2000):
        word = bytes(random.choice(b"ab") for _ in range(random.randint(1, 9)))
        assert accepts(word) == (word in text)
    assert len(moves) <= 2 * len(text)


def test_held_out_accuracy(spark, sf_dir):
    sf = sf_dir.replace("sf0.001", "sf0.01")
    rows = {r["doc_id"]: r for r in queries.QUERIES["op6_cross_parsing"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert all(rows[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in docs)
    held = [r for r in docs if rows[r["doc_id"]]["held_out"] and r["lang"] and len(r["text"]) > 40]
    assert sum(rows[r["doc_id"]]["lang_pred"] == r["lang"] for r in held) / len(held) >= 0.97


def test_many_languages_keep_their_text(frame):
    """Alphabets that hardly meet; more languages than one would expect."""
    random.seed(12)
    letters = [[chr(0x400 + 24 * k + i) for i in range(24)] + list("abc ") for k in range(8)]
    some = lambda k, n: "".join(random.choice(letters[k]) for _ in range(n)).encode()
    parser = L.Parser({str(k): [some(k, 40_000)] for k in range(8)})
    assert parser.bits == [np.log2(L.TEXT_BYTES)] * 8
    assert len(parser.table) * 8 < 8 * 3 * 8 * L.TEXT_BYTES
    learned = L.fit(frame([(i, f"word{i} of language {i}", f"l{i:03}") for i in range(600)]))
    assert learned.languages == [f"l{i:03}" for i in range(600)]
    texts = [b"word599 of language 599", b"word7 of language 7"]
    best, _ = learned.predict(np.frombuffer(b"".join(texts), np.uint8), np.array([0, len(texts[0]), len(texts[0] + texts[1])]))
    assert len(best) == 2


def test_wrong_labels_are_left_out():
    english, german = (["the cat and the dog went home " + w for w in "abcdef"], ["der hund und die katze gingen heim " + w for w in "abcdef"])
    texts = {"en": [x.encode() for x in english] + [german[5].encode()], "de": [x.encode() for x in german[:5]]}
    kept = L.agreeing(texts)
    assert kept["de"] == texts["de"][::2] + texts["de"][1::2] and german[5].encode() not in kept["en"] and len(kept["en"]) == 6


def test_edges(frame, edge):
    train = frame([(i, "the cat and the dog went to the house of the king", "en") for i in range(5)] + [(i, "der hund und die katze gingen in das haus", "de") for i in range(9, 12)] + [(20, None, "en"), (21, "x", None)])
    parser = L.fit(train)
    assert parser.languages == ["en", "de"]
    rows = L.identify(edge, parser).collect()
    assert len(rows) == 13
    by_id = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in rows}
    assert by_id[1] == by_id[2] == by_id[3] == by_id[10] == ("und", 0.0)
    assert by_id[5] == by_id[6] and by_id[9][0] in ("en", "de")
    none = L.fit(train.limit(0))
    assert {r["lang_pred"] for r in L.identify(edge, none).collect()} == {"und"}
    assert L.identify(frame([]), parser).count() == 0


def test_query_against_brute_force(spark, sf_dir):
    """Every prediction of the query from plain parses of whole texts."""
    import math

    rows = {r["doc_id"]: r for r in queries.QUERIES["op6_cross_parsing"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    taught = [r for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2]
    parser = L.fit(spark.createDataFrame(taught, docs.schema))
    known = {}
    for language in parser.languages:  # the learned text, from the parser's own passages
        known[language] = parser.texts[language]
    for r in docs.collect():
        text = (r["text"] or "").lower()
        if len(text.encode()) > 3000:
            continue
        got = rows[r["doc_id"]]
        if not any(c.isalpha() for c in text):
            assert got["lang_pred"] == "und" and got["score"] == 0
            continue
        cost = [phrases(text.encode(), known[k]) * math.log2(len(known[k])) for k in parser.languages]
        best = min(range(len(cost)), key=cost.__getitem__)
        assert got["lang_pred"] == parser.languages[best]
        assert math.isclose(got["score"], 1 / sum(2.0 ** -min(c - cost[best], 1000) for c in cost), rel_tol=1e-9)
