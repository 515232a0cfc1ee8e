import random

import pytest

from tessera.llm import queries as Q
from tessera.llm import warc

SCHEMA = "page_id long, url string, html string, record_type string, valid string"


def test_query(same_as_sql):
    same_as_sql(Q.QUERIES["op2_segments"], Q.SQL["op2_segments"])


def test_round_trip(spark, tmp_path):
    random.seed(1)
    text = lambda n: "".join(random.choice("aé日\r\n <>") for _ in range(n))
    long = text(200_000)
    rows = [(i, f"http://x/{i}", text(random.choice([0, 5, 300, 5000]))) for i in range(40)]
    rows += [(50, None, None), (51, "http://a b\r\nc", ""), (52, "u", long), (60, "u", "WARC/1.1\r\nContent-Length: 5\r\n\r\n" * 40), (None, "n", "y" * 500), (None, None, None)]
    rows += [(i, "copy", "z" * 400) for i in (9000, 70, 71)] + [(i, "short", "z" * 99) for i in (80, 81)] + [(90, "twice", "w" * 300)] * 2 + [(None, "c", "z" * 400)]
    pages = spark.createDataFrame([(*r, "x", "x") for r in rows], SCHEMA)
    path = str(tmp_path / "archive")
    warc.write(pages, path, segment_bytes=1000, records_per_file=50)
    assert warc.records(spark, path, segmented=True).where("warc_type = 'continuation'").count() > 300
    got = warc.read(spark, path).collect()
    assert len(got) == len(rows) and all(r["valid"] for r in got)
    key = lambda k: -1 if k is None else int(k)
    want = sorted((key(i), len((h or "").encode())) for i, _, h in rows)
    assert sorted((key(r["key"]), r["payload_bytes"]) for r in got) == want
    payloads = {r["key"]: r["payload"].decode() for r in got if r["payload"] is not None}
    for i, _, h in rows:
        if i is not None and i not in (71, 9000):
            assert payloads[str(i)] == (h or "")
    kinds = {(r["key"], r["record_type"], r["refers_to"]) for r in got}
    assert {("70", "response", None), ("71", "revisit", "70"), ("9000", "revisit", "70"), (None, "revisit", "70"), ("80", "response", None), ("81", "response", None), ("90", "response", None), ("90", "revisit", "90")} <= kinds


def test_broken_segments(spark):
    """A missing, wrong or short segment makes a record invalid, not lost."""
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + warc._chunked(b"abc" * 10)
    row = lambda name, number, total, part: (f"<urn:x-page:{name}:0>" if number == 1 else f"<c{name}{number}>", None, "response", None, None, None if number == 1 else f"<urn:x-page:{name}:0>", str(number), total, part)
    parts = [block[:20], block[20:50], block[50:]]
    good = [row(1, k + 1, str(len(block)) if k == 2 else None, p) for k, p in enumerate(parts)]
    gap = [row(2, 1, None, parts[0]), row(2, 3, str(len(block)), parts[2])]
    wrong = [row(3, k + 1, str(len(block) + 1) if k == 2 else None, p) for k, p in enumerate(parts)]
    random.shuffle(good)
    rows = {r["warc_record_id"][12]: r for r in warc.reassembled(spark.createDataFrame(good + gap + wrong, warc._RAW)).collect()}
    assert rows["1"]["whole"] and bytes(rows["1"]["block"]) == block and not rows["2"]["whole"] and not rows["3"]["whole"]


def test_revisits_of_broken_responses(spark, tmp_path):
    """A revisit whose response is missing, damaged or another one is not valid."""
    import hashlib

    good, bad = b"z" * 400, b"y" * 300
    name = lambda b: hashlib.sha256(b).hexdigest()
    made = [(1, good, name(good), None), (2, good, name(good), (1, 1)), (3, good, name(good), (99, 99)), (4, bad, name(good), None), (5, bad, name(good), (4, 4)), (6, bad, name(bad), (1, 1)), (7, good, name(good), (2, 2))]
    parts = [r for i, body, digest, first in made for r in warc.records_of(i, f"u{i}", body, i, digest, first, 1 << 20, "2026-01-01T00:00:00Z")]
    (tmp_path / "part-0").write_bytes(b"".join(p + b"\r\n\r\n" for p in parts))
    for payload in (False, True):
        got = {int(r["key"]): r for r in warc.read(spark, str(tmp_path), payload=payload).collect()}
        assert {k: r["valid"] for k, r in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False}
    assert bytes(got[1]["payload"]) == good and got[2]["payload"] is None


@pytest.mark.parametrize("body,want", [(b"3\r\nabc\r\n0\r\n\r\n", b"abc"), (b"3;x=y\r\nabc\r\n2\r\nde\r\n0\r\nT: v\r\n\r\n", b"abcde"), (b"0\r\n\r\n", b""), (b"5\r\nabc\r\n0\r\n\r\n", None), (b"zz\r\n", None), (b"", None)])
def test_dechunk(body, want):
    assert warc.dechunk(body) == want


def test_members_and_segments_take_time_in_proportion(spark, tmp_path):
    """An archive of a member a record, as crawlers write them, and a page of many segments."""
    import gzip
    import time

    def seconds(n):
        data = b"".join(gzip.compress(b"WARC/1.1\r\nWARC-Type: x\r\nContent-Length: 400\r\n\r\n" + random.randbytes(400) + b"\r\n\r\n") for _ in range(n))
        began = time.perf_counter()
        assert sum(1 for _ in warc.parse(warc.unzip(data))) == n
        return time.perf_counter() - began

    seconds(500)
    assert seconds(24_000) < 40 * seconds(2_000)  # in proportion 12 times, by squares 144 times
    assert warc.unzip(b"plain") == b"plain" and warc.unzip(gzip.compress(b"")) == b"" and warc.unzip(gzip.compress(b"a") + b"\0" * 9) == b"a"
    html = "".join(random.choices("abc é日", k=3_000_000))
    warc.write(spark.createDataFrame([(1, None, html, "x", "x")], SCHEMA), str(tmp_path / "large"), segment_bytes=500)
    (page,) = warc.read(spark, str(tmp_path / "large")).collect()
    assert page["valid"] and bytes(page["payload"]).decode() == html


def test_empty(spark, tmp_path):
    path = str(tmp_path / "none")
    warc.write(spark.createDataFrame([], SCHEMA), path)
    assert warc.read(spark, path).count() == 0
