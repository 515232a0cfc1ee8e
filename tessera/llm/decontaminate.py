"""Benchmark decontamination by winnowing.

Each item and each document keep the minimum 5-gram hash of every window of 6 grams.
Two texts that share 10 words share such a window and so a fingerprint; each shared
fingerprint is extended word by word, which leaves only true matches of 10 words.
Items of fewer than 10 words are one window each and are looked up by their own length.

The documents are read in one pass without a shuffle. The fingerprints of the items go to
the executors in blocks of at most `block_bytes` of item text; there are as many passes as
blocks, with a stored table between them, so memory is bounded for any benchmark.

Null texts have no words; items with a null id or no words take no part; repeated item ids
count once. Columns of the documents with the name of a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import words as W
from tessera.llm.common import discard, stored, tiles, utf8_buffers

#: Words that a match needs, of a gram, and grams in a window: WINDOW = GRAM + GRAMS - 1.
WINDOW, GRAM, GRAMS = 10, 5, 6
BLOCK_BYTES = 16 << 20
#: Pairs of equal fingerprints that are extended at once.
PAIRS = 1 << 18

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("hit_spans", _SPANS),
    T.StructField("hit_items", T.ArrayType(T.StringType())),
]


def winnow(words: np.ndarray, offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Positions of the fingerprints: the last minimum of every window of each text."""
    starts, _ = W.gram_owner(offsets, WINDOW)
    if not len(starts):
        return starts
    best, at = hashes[starts], np.zeros(len(starts), np.int64)
    for j in range(1, GRAMS):
        other = hashes[starts + j]
        less = other <= best
        best = np.where(less, other, best)
        at[less] = j
    chosen = np.zeros(len(words), bool)
    chosen[starts + at] = True
    return np.flatnonzero(chosen)


class ItemIndex:
    """Fingerprints of a block of items, sorted for lookup."""

    def __init__(self, ids: list[str], texts: list[str]):
        self.ids = ids
        self.words, self.offsets = W.split_words(*utf8_buffers(pa.array(texts, pa.large_string())))
        sizes = np.diff(self.offsets)
        self.owner = np.repeat(np.arange(len(ids)), sizes)
        hashes = W.grams(self.words, GRAM)
        at = winnow(self.words, self.offsets, hashes)
        at = self._telling(at)
        order = np.argsort(hashes[at], kind="stable")
        self.at, self.prints = at[order], hashes[at][order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.prints >> np.uint64(44)).astype(np.int64)] = True
        self.short = {}
        for size in range(1, WINDOW):
            if len(items := np.flatnonzero(sizes == size)):
                keys = W.grams(self.words, size)[self.offsets[items]]
                order = np.argsort(keys, kind="stable")
                self.short[size] = keys[order], items[order]

    def _telling(self, at: np.ndarray) -> np.ndarray:
        """One of those positions of an item that have the same words around them, as far as a hit
        is extended: a repetitive item has few."""
        item = self.owner[at]
        around = W.mix(item.astype(np.uint64))
        for j in range(GRAM - WINDOW, WINDOW):
            k = at + j
            inside = (k >= self.offsets[item]) & (k < self.offsets[item + 1])
            word = np.where(inside, self.words[np.clip(k, 0, max(len(self.words) - 1, 0))], np.uint64(j + WINDOW))
            around = W.mix(around * np.uint64(0x9E3779B97F4A7C15) + word)
        return at[np.sort(np.unique(around, return_index=True)[1])]

    def _found(self, keys: np.ndarray, sorted_keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (index into keys, index into sorted_keys) of equal values, about PAIRS at a time."""
        low = np.searchsorted(sorted_keys, keys, "left")
        count = np.searchsorted(sorted_keys, keys, "right") - low
        some = np.flatnonzero(count)
        if not len(some):
            return
        low, count = low[some], count[some]
        begin = np.cumsum(count) - count
        cuts = np.flatnonzero(np.diff(begin // PAIRS, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(some)]):
            left = np.repeat(np.arange(a, b), count[a:b])
            yield some[left], np.arange(len(left)) - begin[left] + begin[a] + low[left]

    def hits(self, words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A flag for each word of the texts, and unique pairs text * items + item. Whatever the
        repetitions, memory is bounded by the words, the pairs of texts and items, and PAIRS."""
        n, edge = len(words), np.zeros(len(words) + 1, np.int64)
        text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        pairs = []
        hashes = W.grams(words, GRAM)
        at = winnow(words, offsets, hashes)
        at = at[self.seen[(hashes[at] >> np.uint64(44)).astype(np.int64)]]
        for left, right in self._found(hashes[at], self.prints):
            p, q = at[left], self.at[right]
            text, item = text_of[p], self.owner[q]
            same = np.ones(len(p), bool)
            for j in range(GRAM):
                same &= words[p + j] == self.words[q + j]
            p, q, text, item = p[same], q[same], text[same], item[same]
            begin, end = offsets[text], offsets[text + 1]
            own_begin, own_end = self.offsets[item], self.offsets[item + 1]
            back, ahead = np.zeros(len(p), np.int64), np.zeros(len(p), np.int64)
            for step, side in ((-1, back), (1, ahead)):
                going = np.ones(len(p), bool)
                for j in range(1, WINDOW - GRAM + 1):
                    i, k = (p - j, q - j) if step < 0 else (p + GRAM - 1 + j, q + GRAM - 1 + j)
                    going &= (i >= begin) & (i < end) & (k >= own_begin) & (k < own_end)
                    going[going] = words[i[going]] == self.words[k[going]]
                    side += going
            full = back + GRAM + ahead >= WINDOW
            np.add.at(edge, (p - back)[full], 1)
            np.add.at(edge, (p + GRAM + ahead)[full], -1)
            pairs.append(np.unique(text[full] * len(self.ids) + item[full]))
        for size, (keys, items) in self.short.items():
            starts, owner = W.gram_owner(offsets, size)
            if not len(starts):
                continue
            for left, right in self._found(W.grams(words, size)[starts], keys):
                np.add.at(edge, starts[left], 1)
                np.add.at(edge, starts[left] + size, -1)
                pairs.append(np.unique(owner[left] * len(self.ids) + items[right]))
        unique = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        return np.cumsum(edge[:n]) > 0, unique


def _spans(flags: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of flagged words: their number by text, and starts and ends within the text."""
    if not flags.any():
        return np.zeros(len(offsets) - 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = flags.copy(), flags.copy()
    first[1:] &= ~flags[:-1]
    last[:-1] &= ~flags[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < len(flags))]
    first[inner] = flags[inner]
    last[inner - 1] = flags[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    return np.bincount(text, minlength=len(offsets) - 1), starts - offsets[text], ends - offsets[text]


def _merge_spans(old: list, new: list) -> list:
    merged: list[dict] = []
    for span in sorted([*(old or []), *(new or [])], key=lambda s: s["start"]):
        if merged and span["start"] <= merged[-1]["end"]:
            merged[-1]["end"] = max(merged[-1]["end"], span["end"])
        else:
            merged.append(dict(span))
    return merged


def _pass(docs: DataFrame, index, text: str, keep: list[str], again: bool) -> DataFrame:
    """One block of items against all documents; `again`: add to the results of another block."""
    names = {f.name for f in _RESULT}
    schema = T.StructType([f for f in docs.schema.fields if f.name in keep and f.name not in names] + _RESULT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: ItemIndex = index.value
        ids = pa.array(items.ids, pa.string())
        for batch in batches:
            data, offsets = utf8_buffers(batch.column(text))
            n_words, n_hit, n_spans, n_items, starts, ends, found = [], [], [], [], [], [], []
            for a, b in tiles(offsets):
                words, at = W.text_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                flags, pairs = items.hits(words, at)
                total = np.concatenate([[0], np.cumsum(flags)])
                n_words.append(np.diff(at))
                n_hit.append(np.diff(total[at]))
                count, s, e = _spans(flags, at)
                n_spans.append(count)
                starts.append(s)
                ends.append(e)
                n_items.append(np.bincount(pairs // max(len(ids), 1), minlength=b - a))
                found.append(pairs % max(len(ids), 1))
            join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
            bounds = lambda x: pa.array(np.concatenate([[0], np.cumsum(join(x))]), pa.int32())
            spans = pa.StructArray.from_arrays([pa.array(join(starts)), pa.array(join(ends))], ["start", "end"])
            span_lists = pa.ListArray.from_arrays(bounds(n_spans), spans)
            item_lists = pa.ListArray.from_arrays(bounds(n_items), ids.take(pa.array(join(found))))
            hit = pa.array(join(n_hit))
            if again:
                merged = [_merge_spans(x, y) for x, y in zip(batch.column("hit_spans").to_pylist(), span_lists.to_pylist())]
                span_lists = pa.array(merged, span_lists.type)
                hit = pa.array([sum(s["end"] - s["start"] for s in x) for x in merged], pa.int64())
                both = zip(batch.column("hit_items").to_pylist(), item_lists.to_pylist())
                item_lists = pa.array([sorted({*x, *y}) for x, y in both], item_lists.type)
            own = [batch.column(f.name) for f in schema.fields[: -len(_RESULT)]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(join(n_words)), hit, span_lists, item_lists], names=schema.names)

    return docs.mapInArrow(run, schema)


def scan(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", keep: list[str] | None = None,
         item_id: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The `keep` columns of all documents (default: all) with n_words, n_hit, hit_spans (word
    ranges) and hit_items (ids as text, sorted, each once)."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("t")).where("id is not null and t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    keep = docs.columns if keep is None else keep
    out, before = docs, []
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).collect()  # block_bytes on average
        rows.sort(key=lambda r: (r.id, r.t))
        index = spark.sparkContext.broadcast(ItemIndex([r.id for r in rows], [r.t for r in rows]))
        last = k == blocks - 1
        names = list(dict.fromkeys([*keep, *([] if last else [text])]))
        out = _pass(out, index, text, names, again=k > 0)
        if blocks > 1:  # of the tables between the passes the last one stays, which has no texts
            served = before.copy()
            before = []
            out = stored(out, "decontaminate", into=before)
            discard(spark, served)
    # an id that repeats in the items counts once
    return out.withColumn("hit_items", F.array_sort(F.array_distinct("hit_items")))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents without a hit, with their own columns."""
    columns = docs.columns
    names = {f.name for f in _RESULT}
    hidden = docs.withColumnsRenamed({c: f"{c}__own" for c in columns if c in names})
    back = {f"{c}__own": c for c in columns if c in names}
    return scan(hidden, benchmark, **options).where("n_hit = 0").drop(*names).withColumnsRenamed(back).select(columns)
