"""License notices by conditional compression.

Each place of a text with one of the cue words makes a candidate block, the text up to twice as
many words before and after it as the longest template has, which holds any notice about that
word, however its lines are broken, indented or commented. Each template is loaded
as a zstandard raw dictionary, the block is compressed with and without it, both in lower case
and with single spaces, and templates are ranked by the share of bytes they save. In that order
they are checked on words, whatever they save: the template's words are aligned with the block's,
and the first template of which at least 0.8 stand there in order, with all that tell it from
others, is the notice, put out with its exact differences; of templates that save as much but for
CLOSE, the one that has the most words right, less those that differ. Version numbers and other fields of a
template take any word. Only templates whose words are in the block at all are compressed.

Whole texts are searched in one pass, without a shuffle. Null and empty texts have no notice;
equal savings go to the template that comes first; repeated rows are rows each. Columns of the
documents with the name of a result are replaced.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Wordings of common license notices. {} stands for a word that may be any.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "MIT-full": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "Apache": "Licensed under the Apache License, Version {}.",
    "Apache-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "GPL": "This work is licensed under the GNU General Public License, version {}.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version.",
    "LGPL": "This library is licensed under the GNU Lesser General Public License, version {}.",
    "AGPL": "This work is licensed under the GNU Affero General Public License, version {}.",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL": "This Source Code Form is subject to the terms of the Mozilla Public License, v. {}. If a copy of the MPL was not distributed with this file, You can obtain one at",
    "CC-BY": "Licensed under CC BY {}.",
    "CC-BY-SA": "Licensed under CC BY-SA {}.",
    "CC-BY-NC": "Licensed under CC BY-NC {}.",
    "CC-BY-ND": "Licensed under CC BY-ND {}.",
    "CC-BY-text": "This work is licensed under a Creative Commons Attribution {} International License.",
    "CC0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "proprietary": "All rights reserved.",
    "SPDX": "SPDX-License-Identifier: {}",
}
#: The words that make a block a candidate: every template has one of them. Between two words may
#: stand a line's end and the mark of a comment.
CUES = r"(?i)licen[sc]|copyright|copyleft|permi(?:ssion|tted)|redistribut|creative\W+commons|public\W+domain|rights\W+reserved|free\W+software|\bCC[ -]BY|\bSPDX\b"
CONFIRMED, CLOSE = 0.8, 0.02

_WORD = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*|\{\}")

def words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


@cache
def _lists() -> dict[str, list[str]]:
    return {k: words(v) for k, v in TEMPLATES.items()}


@cache
def _telling() -> dict[str, set[str]]:
    """Of the templates of fewer than 20 words, the words that no other such template has: they
    tell one license from another, and none of them may be lost."""
    short = {k: set(words(v)) - {"{}"} for k, v in TEMPLATES.items() if len(words(v)) < 20}
    return {k: own - set().union(*[v for j, v in short.items() if j != k]) for k, own in short.items()}


@cache
def _counted() -> dict[str, Counter]:
    return {k: Counter(v) for k, v in _lists().items()}


def possible(block_words: list[str]) -> list[str]:
    """The templates that these words may confirm: enough of a template's words are among them,
    in whatever order, and all that tell it from others."""
    own = Counter(block_words)
    return [k for k, wanted in _counted().items() if _telling().get(k, set()) <= own.keys() and (wanted & own).total() >= CONFIRMED * (wanted.total() - wanted["{}"])]


def _folded(text: str) -> bytes:
    return " ".join(text.lower().split()).encode()


@cache
def _compressors() -> tuple:
    import zstandard

    dictionaries = [zstandard.ZstdCompressionDict(_folded(t.replace("{}", "")), dict_type=zstandard.DICT_TYPE_RAWCONTENT) for t in TEMPLATES.values()]
    for d in dictionaries:
        d.precompute_compress(level=3)
    return zstandard.ZstdCompressor(level=3), {k: zstandard.ZstdCompressor(level=3, dict_data=d) for k, d in zip(TEMPLATES, dictionaries, strict=True)}


def savings(block: str, names: list[str]) -> list[tuple[float, str]]:
    """(share of bytes saved, template) of these templates, the best first."""
    plain, conditional = _compressors()
    data = _folded(block)
    alone = len(plain.compress(data))
    saved = [((alone - len(conditional[name].compress(data))) / alone, name) for name in names]
    return sorted(saved, key=lambda x: -x[0])


def differences(name: str, block_words: list[str]) -> tuple[float, int, int, list[str]]:
    """Share of the template's words that stand in the block in order, the words' range there,
    and the differences as -word (of the template) and +word (of the block) within it."""
    wanted = words(TEMPLATES[name])
    fixed = [w for w in wanted if w != "{}"]
    matcher = difflib.SequenceMatcher(None, wanted, block_words, autojunk=False)
    core = matcher.find_longest_match(0, len(wanted), 0, len(block_words))
    if not core.size:
        return 0.0, 0, 0, []
    # words of the template can only lie about where its longest run puts them
    more = 4 + len(wanted) // 4  # words that may have been put in
    low = max(0, core.b - core.a - more)
    high = min(len(block_words), core.b + len(wanted) - core.a + more)
    matcher = difflib.SequenceMatcher(None, wanted, block_words[low:high], autojunk=False)
    runs = [m for m in matcher.get_matching_blocks() if m.size]
    first, last = runs[0].b, runs[-1].b + runs[-1].size
    found = sum(m.size for m in runs)
    changes: list[str] = []
    for kind, i, j, a, b in matcher.get_opcodes():
        if kind == "equal":
            continue
        lost, new = wanted[i:j], block_words[low + max(a, first) : low + min(b, last)]
        if lost == ["{}"] and a >= last and b > a:  # a field at the end of the notice
            new = block_words[low + a : low + a + 1]
            last = a + 1
        if "{}" in lost and new:
            lost = [w for w in lost if w != "{}"]
            new = new[1:]
        changes += [f"-{w}" for w in lost if w != "{}"] + [f"+{w}" for w in new]
    return found / len(fixed), low + first, low + last, changes


def notices(text: str) -> list[dict]:
    """The confirmed notices of a text in order of place: license, saved, match, start, end,
    quote and differences."""
    reach = 2 * max(map(len, _lists().values()))
    found: list[dict] = []  # by place; they do not overlap
    starts: list[int] = []
    places = own = None
    for hit in re.finditer(CUES, text):
        if places is None:
            places = [m.span() for m in _WORD.finditer(text)]
            own = [text[a:b].lower() for a, b in places]
            firsts = [a for a, _ in places]
        nth = bisect_right(firsts, hit.start())
        low, high = max(0, nth - reach), min(len(places), nth + reach)
        while low < high:
            after = bisect_right(starts, hit.start())
            near = found[max(0, after - 1) : after + 1]
            if any(n["start"] < hit.end() and n["end"] > hit.start() for n in near):
                break
            note = _best(text, places[low:high], own[low:high])
            if note is None:
                break
            at = bisect_right(starts, note["start"])
            found.insert(at, note)
            starts.insert(at, note["start"])
            # what is found already is not found again
            for k in range(bisect_left(firsts, note["start"]), bisect_left(firsts, note["end"])):
                own[k] = ""
    return found


def _best(text: str, places: list[tuple[int, int]], own: list[str]) -> dict | None:
    """The template that saves most of those that the words confirm; words that other notices
    took are empty."""
    names = possible(own)
    if not names:
        return None
    spans = [(key, list(group)) for key, group in groupby(range(len(own)), lambda k: own[k] == "")]
    block = "\n".join(text[places[run[0]][0] : places[run[-1]][1]] for taken, run in spans if not taken)
    best = None
    for saved, name in savings(block, names):
        if best and saved < best["saved"] - CLOSE:
            break
        match, first, last, changes = differences(name, own)
        lost = {c[1:] for c in changes if c[0] == "-"}
        # one notice lies between the words of others, not around them
        if match >= CONFIRMED and not lost & _telling().get(name, set()) and "" not in own[first:last]:
            start, end = places[first][0], places[last - 1][1]
            note = {"license": name, "saved": round(saved, 4), "match": round(match, 4), "start": start, "end": end, "quote": text[start:end], "differences": changes}
            right = match * sum(w != "{}" for w in _lists()[name]) - len(changes)
            if best is None or right > best["right"]:
                best = {**note, "right": right}
    return best and {k: v for k, v in best.items() if k != "right"}


_NOTICES = T.ArrayType(T.StructType([
    T.StructField("license", T.StringType()), T.StructField("saved", T.DoubleType()), T.StructField("match", T.DoubleType()),
    T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("quote", T.StringType()), T.StructField("differences", T.ArrayType(T.StringType())),
]))


def scan(docs: DataFrame, *, text: str = "text", keep: list[str] | None = None, name: str = "notices") -> DataFrame:
    """The `keep` columns of the documents (default: all) with the list of their notices."""
    keep = docs.columns if keep is None else keep
    fields = [docs.schema[c] for c in keep if c not in (name, "__candidate")]
    schema = T.StructType([*fields, T.StructField(name, _NOTICES)])
    kind = pa.list_(pa.struct([("license", pa.string()), ("saved", pa.float64()), ("match", pa.float64()), ("start", pa.int64()), ("end", pa.int64()), ("quote", pa.string()), ("differences", pa.list_(pa.string()))]))
    marked = docs.withColumn("__candidate", F.when(F.col(text).rlike(CUES), F.col(text)))
    rows = marked.select(*[f.name for f in fields], "__candidate")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [notices(t) if t else [] for t in batch.column("__candidate").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], pa.array(found, kind)], names=schema.names)

    return rows.mapInArrow(run, schema)
