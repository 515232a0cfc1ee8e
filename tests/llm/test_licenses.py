import json
import random

import pytest

from tessera.llm import licenses as L
from tessera.llm import queries


@pytest.mark.parametrize("name", list(L.TEMPLATES))
def test_templates_find_themselves(name):
    text = "Some words before. \n" + L.TEMPLATES[name].replace("{}", "9.9") + "\n and some after."
    assert [(n["license"], n["match"], n["differences"]) for n in L.notices(text)] == [(name, 1.0, [])]


@pytest.mark.parametrize("case", [str.upper, str.lower, str.title, lambda t: t.replace(" ", "\n * ")])
@pytest.mark.parametrize("name", list(L.TEMPLATES))
def test_templates_in_other_writing(name, case):
    """In the middle of prose whose own bytes outweigh the notice's."""
    random.seed(6)
    prose = lambda: " ".join(random.choice(["river", "stone", "meadow", "walked", "under", "quiet", "of", "the", "morning", "and"]) for _ in range(120))
    notice = case(L.TEMPLATES[name].replace("{}", "9.9"))
    text = f"{prose()}. {notice}\n{prose()}"
    (note,) = L.notices(text)
    assert (note["license"], note["match"], note["differences"]) == (name, 1.0, [])
    assert text[note["start"] : note["end"]] == note["quote"] and notice.startswith(note["quote"].split()[0])


def test_spdx():
    (note,) = L.notices("# SPDX-License-Identifier: Apache-2.0\nimport os\n")
    assert note["license"] == "SPDX" and note["quote"] == "SPDX-License-Identifier: Apache-2.0"


@pytest.mark.parametrize("name", ["MIT-full", "MIT-text", "BSD-2-Clause", "BSD-3-Clause", "GPL-header"])
def test_commented_notices_of_any_length_are_whole(name):
    words = L.TEMPLATES[name].replace("{}", "3").split()
    lines = "".join(" *" + " " * 40 + " ".join(words[i : i + 3]) + "\n" for i in range(0, len(words), 3))
    (note,) = L.notices("int a;\n/*\n" + lines + " */\nint b;\n")
    assert (note["license"], note["match"], note["differences"]) == (name, 1.0, [])


def test_many_notices_take_time_in_proportion():
    import time

    def seconds(n):
        began = time.perf_counter()
        assert len(L.notices("five plain words stand here. All rights reserved. " * n)) == n
        return time.perf_counter() - began

    seconds(50)
    assert seconds(3000) < 40 * seconds(250)  # in proportion 12 times, by squares 144 times


def plain_ranking(block, names):
    """Templates by the share of bytes that each saves as a raw dictionary, one by one."""
    import zstandard

    fold = lambda t: " ".join(t.lower().split()).encode()
    size = lambda **d: len(zstandard.ZstdCompressor(level=3, **d).compress(fold(block)))
    share = {}
    for name in names:
        raw = zstandard.ZstdCompressionDict(fold(L.TEMPLATES[name].replace("{}", "")), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        share[name] = (size() - size(dict_data=raw)) / size()
    return share


@pytest.mark.parametrize("name", list(L.TEMPLATES))
def test_ranking_against_plain_compression(name):
    block = "Here it is: " + L.TEMPLATES[name].replace("{}", "4.0")
    want = plain_ranking(block, L.TEMPLATES)
    got = L.savings(block, list(L.TEMPLATES))
    assert {k: round(v, 2) for v, k in got} == {k: round(v, 2) for k, v in want.items()}
    # no template saves clearly more of a block than the notice found in it
    (note,) = L.notices(block)
    assert note["license"] == name and note["saved"] >= max(plain_ranking(block, L.possible(L.words(block))).values()) - L.CLOSE - 0.01


def test_differences_are_exact():
    text = L.TEMPLATES["MIT-text"].replace("sublicense, ", "").replace("charge", "cost")
    (note,) = L.notices("x\n" + text)
    assert note["license"] == "MIT-text" and note["differences"] == ["-charge", "+cost", "-sublicense"] and note["match"] < 1
    assert text.startswith(note["quote"])


def test_several_notices_in_a_long_line():
    text = "Licensed under the Apache License, Version 2.0. " + "bar baz " * 3000 + "Licensed under CC BY 4.0 and All rights reserved."
    assert [n["license"] for n in L.notices(text)] == ["Apache", "CC-BY", "proprietary"]
    assert all(text[n["start"] : n["end"]] == n["quote"] for n in L.notices(text))


@pytest.mark.parametrize("text", ["", "no notice here", "Released under the Foo License.", "a driving license and permission to stay", "copyright"])
def test_no_notice(text):
    assert L.notices(text) == []


def test_query_against_plain_search(spark, sf_dir):
    """The lines that these tables hold, found by plain text search."""
    sf = sf_dir.replace("sf0.001", "sf0.01")
    lines = {"Licensed under the Apache License, Version 2.0": "Apache", "Released under the MIT License": "MIT", "Licensed under CC BY-NC 4.0": "CC-BY-NC", "licensed under the GNU General Public License, version 3": "GPL", "All rights reserved": "proprietary"}
    rows = queries.QUERIES["op4_conditional_compression"](spark, sf).collect()
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        want = sorted({v for k, v in lines.items() if k in docs[r["doc_id"]]})
        assert r["licenses"] == ",".join(want), r["doc_id"]
        assert all(docs[r["doc_id"]][n["start"] : n["end"]] == n["quote"] for n in json.loads(r["notices"]))


def test_edges(frame, edge):
    rows = L.scan(edge).collect()
    assert len(rows) == 13 and not any(r["notices"] for r in rows)
    assert L.scan(frame([])).count() == 0
    twice = frame([(1, "All rights reserved."), (1, "All rights reserved."), (2, "x " * 200_000 + "All rights reserved.")])
    assert [len(r["notices"]) for r in L.scan(twice, keep=["doc_id"]).collect()] == [1, 1, 1]
