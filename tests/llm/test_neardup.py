import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm import bagminhash as B
from tessera.llm import neardup as N
from tessera.llm import words as W
from tessera.llm.common import utf8_buffers
from tessera.llm.components import components


def bag(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    import re

    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", words)
    k = min(5, len(words))
    return Counter(tuple(words[i : i + k]) for i in range(len(words) - k + 1)) if words else Counter()


def brute(rows):
    """Classes by least id of all links, from an inverted index; rows: (id, text)."""
    bags = [bag(t) for _, t in rows]
    at = list(range(len(rows)))

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    index, shared = defaultdict(list), Counter()
    for i, b in enumerate(bags):
        for s, c in b.items():
            for j, d in index[s]:
                shared[j, i] += min(c, d)
            index[s].append((i, c))
    for (i, j), m in shared.items():
        if m >= 0.8 * (bags[i].total() + bags[j].total() - m) - 1e-9:
            at[find(i)] = find(j)
    empty = {}
    for i, (_, t) in enumerate(rows):
        if not bags[i]:
            at[find(i)] = find(empty.setdefault(t or "", i))
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(least.get(find(i), key), key)
    return sorted((str(key), str(least.get(find(i)))) for i, (key, _) in enumerate(rows))


def classes(docs):
    return sorted((str(r["doc_id"]), str(r["class_id"])) for r in N.classes(docs).collect())


def test_table(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert classes(spark.read.parquet(f"{sf_dir}/documents.parquet")) == brute(rows)


def test_groups_of_near_copies(spark, frame):
    """Copies of a text with more and more changes: chains, hubs and leftovers."""
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [random.choice(vocabulary) for _ in range(150)]
    rows = []
    for i in range(160):
        words = base.copy()
        for _ in range(random.randint(0, 9)):
            words[random.randrange(len(words))] = random.choice(vocabulary) + str(random.random())
        rows.append((i, " ".join(words)))
    chain = [random.choice(vocabulary) for _ in range(200)]
    for i in range(40):
        rows.append((1000 + i, " ".join(chain[i * 2 : i * 2 + 120])))
    rows += [(2000 + i, " ".join(random.choice(vocabulary) for _ in range(60))) for i in range(40)]
    rows += [(3000, "a b c " * 100), (3001, "a b c " * 95), (3002, "a b c " * 50)]
    assert classes(frame(rows)) == brute(rows)


def test_edges(frame, edge):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    assert classes(edge) == brute(rows)
    kept = N.deduplicate(edge)
    assert kept.columns == edge.columns
    ids = sorted(str(r["doc_id"]) for r in kept.collect())
    assert ids == sorted(["1", "3", "4", "5", "7", "8", "9", "10", "None", "None"])
    assert N.classes(frame([])).count() == 0 and N.deduplicate(frame([])).count() == 0


def test_rows_are_dropped_one_by_one(frame):
    """An id with several texts, and copies without an id."""
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(30)) for x in "abcd")
    rows = [(2, a), (5, a), (5, b), (6, c), (6, c), (7, c), (None, d), (None, d), (None, d + " end"), (8, None), (8, "")]
    kept = sorted((str(r["doc_id"]), r["text"] or "") for r in N.deduplicate(frame(rows)).collect())
    assert kept[:3] + kept[3:4] == [("2", a), ("5", b), ("6", c), ("8", "")]
    assert len(kept) == 5 and kept[4][0] == "None" and kept[4][1].startswith(d)


def test_profiles_never_bound_too_low():
    """Of bags of any size, with counts beyond a byte, and of sizes that differ."""
    random.seed(5)
    raw, bags = [], []
    for size in (0, 1, 3, 200, 600, 700, 5000, 40_000):
        for most in (1, 3, 2000):
            grams = np.unique(W.mix(np.array(random.sample(range(60_000), size), np.uint64)))
            counts = np.array([random.randint(1, most) for _ in grams], np.int64)
            raw += B.profiles(grams, np.zeros(len(grams), np.int64), counts, 1)
            bags.append(Counter(dict(zip(grams.tolist(), counts.tolist()))))
    several = B.Profiles(raw)
    every = np.arange(len(raw))
    for k, bag_ in enumerate(bags):
        shared = np.array([(bag_ & other).total() for other in bags])
        for enough in (0, 1 << 60):
            assert (several.most_shared(k, several, every, np.full(len(raw), enough)) >= shared).all()
    assert several.most_shared(12, several, np.array([12]), np.array([0])) == [bags[12].total()]


def test_hot_bucket_of_unlinked_texts(frame, monkeypatch):
    """Texts that share much, of which few are links, in buckets dealt over several parts."""
    monkeypatch.setattr(N, "MEMBERS_PER_SALT", 8)
    monkeypatch.setattr(N, "PACKET", 5)
    monkeypatch.setattr(N, "HUB_SAMPLE", 4)
    random.seed(9)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(90):
        words = base.copy()
        at = random.randrange(150)
        words[at : at + 16] = [f"u{i // 2}x{j}" for j in range(16)]
        if i % 2:
            words[(at + 60) % 190] = f"v{i}"
        rows.append((i, " ".join(words)))
    assert classes(frame(rows)) == brute(rows)


def test_hot_keys_of_joins(frame, monkeypatch):
    """One text of many rows, one class of many texts and its hub, all above the limit."""
    rng = random.Random(11)
    words = [f"w{rng.randrange(4000)}" for _ in range(200)]
    rows = [(i, " ".join(words)) for i in range(40)] + [(40 + i, " ".join([*words, f"x{i}"])) for i in range(40)]
    rows += [(80 + i, " ".join(f"y{rng.randrange(4000)}" for _ in range(60))) for i in range(20)] + [(None, " ".join(words))] * 3
    monkeypatch.setattr(N, "MEMBERS_PER_SALT", 4)
    assert classes(frame(rows)) == brute(rows)
    kept = sorted((r["doc_id"] is None, r["doc_id"]) for r in N.deduplicate(frame(rows)).select("doc_id").collect())
    assert kept == [(False, 0), *[(False, 80 + i) for i in range(20)], (True, None)]


def test_recall_of_edited_copies(frame):
    """What the similarity of 0.8 on five words means for copies with a share of words replaced:
    all with up to 2 %, few with 4 % and more."""
    random.seed(12)
    word = lambda: f"{random.choice('abcdefgh')}{random.randrange(3000)}"
    rows, found = [], {}
    for share in (0.005, 0.01, 0.02, 0.04):
        for nth in range(25):
            key = len(rows)
            text = [word() for _ in range(400)]
            copy = text.copy()
            for at in random.sample(range(400), round(400 * share)):
                copy[at] = word() + "x"
            rows += [(key, " ".join(text)), (key + 1, " ".join(copy))]
            found[key + 1] = share
    got = dict(classes(frame(rows)))
    recall = {s: sum(got[str(k)] == str(k - 1) for k, x in found.items() if x == s) / 25 for s in set(found.values())}
    assert recall[0.005] == recall[0.01] == 1 and recall[0.02] >= 0.9 and recall[0.04] <= 0.1


def test_signature_is_unbiased():
    draw = np.random.default_rng(0)
    grams = np.arange(300, dtype=np.uint64)
    a = draw.integers(0, 9, 300)
    b = np.maximum(0, a + draw.integers(-1, 2, 300))
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    found = []
    for seed in range(40):
        g = W.mix(grams + np.uint64(1000 * seed))
        owner = np.repeat([0, 1], [(a > 0).sum(), (b > 0).sum()])
        s = B.signatures(np.concatenate([g[a > 0], g[b > 0]]), owner, np.concatenate([a[a > 0], b[b > 0]]), 2)
        found.append((s[0] == s[1]).mean())
    assert abs(np.mean(found) - want) < 4 * np.std(found) / 40**0.5 + 1e-9


def test_signature_of_a_bag_does_not_depend_on_its_company():
    texts = ["a b c d e f g h", "x y z", "a b c d e f g h " * 30, ""]
    alone = []
    for t in texts:
        data, offsets = utf8_buffers(pa.array([t]))
        alone.append(B.signatures(*N.bags_of(data, offsets), 1)[0])
    data, offsets = utf8_buffers(pa.array(texts))
    together = B.signatures(*N.bags_of(data, offsets), len(texts))
    assert all((x == y).all() for x, y in zip(alone, together))
    assert np.isinf(together[3]).all() and not np.isinf(together[:3]).any()


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)] + [(100, 101), (101, 102), (7, 7)]])
def test_components(spark, edges):
    at = {x: x for e in edges for x in e}

    def find(x):
        while at[x] != x:
            x = at[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        at[max(a, b)] = min(a, b)
    want = {(x, find(x)) for x in at if sum(find(y) == find(x) for y in at) > 1}
    got = components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_query(same_as_sql):
    from tessera.llm import queries as Q

    same_as_sql(Q.QUERIES["op7_bagminhash"], Q.SQL["op7_bagminhash"])
