"""Sum-of-squares online packing of token sequences into windows of fixed length.

Each partition of the documents is one online stream. A document's full windows stand alone;
its rest goes to the fill level that makes the sum of squared counts of partly filled windows
least, which the array `count` tracks by level. A piece is put out as it is placed, so a
stream keeps only the level array, the numbers of its open windows and a queue: the newest
rests, as many tokens as the open windows lack (`queue_tokens` at most). When the stream ends,
the queue is cut to fill the open windows, so that of each stream one window stays part empty.

Ids are those of the `tokenizers` library; the string of an added token in a text is that token.
Null texts are empty and are the end id alone. Repeated rows are packed each for itself, texts
of any length are encoded whole, an empty table gives no pieces. Documents are read in the
order of their partition; the same partitions give the same pieces.
"""

from __future__ import annotations

import json
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tessera.llm.common import tiles, utf8_buffers

WINDOW, END_ID, QUEUE_TOKENS = 2048, 1, 8 << 20
#: Longer texts are encoded in parts of about PART characters, each cut before a space between
#: two words, where every byte-level pattern ends a token. What has no such place for LONG_TEXT
#: characters goes through the tokenizers library, whose time grows less with a run's length.
PART, LONG_TEXT = 1 << 18, 1 << 20
_CUT = re.compile(r"(?<=\S) (?=\S)")

_encoders: dict[str, tuple] = {}


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {**{chr(b): b for b in plain}, **{chr(256 + i): b for i, b in enumerate(rest)}}


def encoders(path: str) -> tuple:
    """(fast encoder, tokenizers' own, added tokens with their ids, pattern that splits at them)
    of a byte-level BPE file; between added tokens both encoders give the same ids.

    The merge ranks of such a file are the order of its ids, so the byte strings of its
    vocabulary with their ids define the fast encoder wholly.
    """
    if path not in _encoders:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] for x in model["added_tokens"]):
            raise ValueError(f"{path}: added tokens that depend on their neighbours")
        added = {x["content"]: x["id"] for x in model["added_tokens"]}
        longest = sorted(added, key=len, reverse=True)  # of those that begin at one place the longest counts
        split = re.compile(f"({'|'.join(map(re.escape, longest))})") if added else None
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in added}
        fast = tiktoken.Encoding("byte-bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        _encoders[path] = fast, Tokenizer.from_file(path), added, split
    return _encoders[path]


def encode(path: str, text: str) -> np.ndarray:
    """The ids of a text, as of tokenizers' encode with add_special_tokens=False: the string of an
    added token is that token."""
    fast, whole, added, split = encoders(path)
    parts = []
    for nth, run in enumerate(split.split(text) if split else [text]):
        if nth % 2:
            parts.append(np.array([added[run]], np.uint32))
            continue
        at = 0
        while at < len(run):
            cut = _CUT.search(run, at + PART) if len(run) - at > PART else None
            part, at = (run[at : cut.start()], cut.start()) if cut else (run[at:], len(run))
            if len(part) <= LONG_TEXT:
                parts.append(np.asarray(fast.encode_to_numpy(part, disallowed_special=()), np.uint32))
            else:
                parts.append(np.array(whole.encode(part, add_special_tokens=False).ids, np.uint32))
    return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


class Packer:
    """Levels of one stream: place() says where a piece of `size` ids goes."""

    def __init__(self, window: int, first_id: int):
        self.window, self.next_id = window, first_id
        self.count = np.zeros(window + 1, np.int64)  # stays 0 at 0 and at the window
        self.open: dict[int, list[int]] = {}
        self.lacking = 0

    def fresh(self) -> int:
        self.next_id += 1
        return self.next_id - 1

    def place(self, size: int) -> tuple[int, int]:
        """(sequence, offset); the fullest of equally good levels, a new window last."""
        count, window = self.count, self.window
        levels = count[1 : window - size + 1]
        level = 0
        if levels.size:
            change = 2 * (count[size + 1 : window + 1] - levels) + 2
            change[-1] -= 1
            change[levels == 0] = 1 << 40
            best = len(change) - 1 - int(change[::-1].argmin())
            if change[best] <= 2 * count[size] + 1:
                level = best + 1
        if level:
            sequence = self.open[level].pop()
            count[level] -= 1
        else:
            sequence = self.fresh()
            self.lacking += window
        self.lacking -= size
        if level + size < window:
            count[level + size] += 1
            self.open.setdefault(level + size, []).append(sequence)
        return sequence, level

    def gaps(self) -> Iterator[tuple[int, int]]:
        """(sequence, fill) of the open windows, the fullest first; then new windows."""
        for level in range(self.window - 1, 0, -1):
            for sequence in self.open.get(level, ()):
                yield sequence, level
        while True:
            yield self.fresh(), 0


_ROWS = pa.schema([("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])


def pack(docs: DataFrame, tokenizer: str, *, text: str = "text", key: str = "doc_id", window: int = WINDOW,
         end_id: int = END_ID, queue_tokens: int = QUEUE_TOKENS) -> DataFrame:
    """A row per piece: key, start, length, doc_tokens, sequence_id, offset and ids (binary,
    little-endian unsigned 32-bit)."""
    key_field = docs.schema[key]
    schema = T.StructType([key_field] + [T.StructField(f.name, T.BinaryType() if f.name == "ids" else T.LongType()) for f in _ROWS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(window, TaskContext.get().partitionId() << 33)
        queue: deque[tuple] = deque()
        queued = 0
        keys, rows = [], []
        key_type = None

        def put(owner, start, ids, total, sequence, offset):
            keys.append(owner)
            rows.append((start, len(ids), total, sequence, offset, ids.tobytes()))

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[] for _ in _ROWS]
            arrays = [pa.array(keys, key_type), *(pa.array(c, f.type) for c, f in zip(columns, _ROWS, strict=True))]
            keys.clear()
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, names=schema.names)

        for batch in batches:
            key_type = batch.column(key).type
            owners, texts = batch.column(key).to_pylist(), batch.column(text)
            _, offsets = utf8_buffers(texts)
            for a, b in tiles(offsets, 1 << 21):
                for owner, body in zip(owners[a:b], texts.slice(a, b - a).to_pylist(), strict=True):
                    ids = np.append(encode(tokenizer, body or ""), np.uint32(end_id))
                    total = len(ids)
                    full = total - total % window
                    for start in range(0, full, window):
                        put(owner, start, ids[start : start + window], total, packer.fresh(), 0)
                    if full < total:
                        queue.append((owner, full, ids[full:].copy(), total))
                        queued += total - full
                    while queue and queued - len(queue[0][2]) >= min(packer.lacking + window, queue_tokens):
                        owner_, start, rest, total_ = queue.popleft()
                        queued -= len(rest)
                        put(owner_, start, rest, total_, *packer.place(len(rest)))
                yield flushed()
        if queue:
            gaps = packer.gaps()
            sequence, fill = next(gaps)
            for owner, start, rest, total in queue:
                while len(rest):
                    if fill == window:
                        sequence, fill = next(gaps)
                    part, rest = rest[: window - fill], rest[window - fill :]
                    put(owner, start, part, total, sequence, fill)
                    start, fill = start + len(part), fill + len(part)
            yield flushed()

    return docs.select(key, text).mapInArrow(run, schema)
