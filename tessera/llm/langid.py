"""Language identification by cross-parsing entropy.

For each language a suffix automaton holds all substrings of a labelled text. A document is
parsed greedily into the longest phrases that the automaton knows; a phrase costs the
logarithm of that language's text length, and the language of least cost per byte wins.

Learned on the driver from at most `passages` passages of `passage_bytes` characters a
language, from rows drawn by hash of id and text and from a hashed place in each. Passages that
automata of the other half of them give to another language are left out; the first TEXT_BYTES
of the others are learned. All languages are, and one's text does not depend on how many there
are. The automata are sparse: 8 bytes a transition, of which a text of n bytes has 3 n at most,
and some free places. So the table, and the work for a byte of text, grow with the number of
languages. Predictions read whole texts in one pass without a shuffle. A text is parsed as a
whole: its pieces of `_STEP` bytes are first parsed side by side, each as if a phrase began with
it, and then from the state in which the piece before ends, as far as that makes a difference.

Null texts and texts without a letter are `und` with score 0, as is everything if no row has
a language. Rows with a null language or text teach nothing; equal costs go to the
language with more rows. Columns of the documents with the name of a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import tiles, utf8_buffers

PASSAGES, PASSAGE_CHARS, TEXT_BYTES = 64, 1024, 1 << 15
_STEP = 1024
#: Places in a piece where a second parsing stops if it is in the state of the first.
_CHECKS = [0, 32, 128, _STEP]
#: Bytes of text parsed at once by up to eight languages, and pieces times languages at once.
_TILE, _AT_ONCE = 1 << 21, 1 << 18

#: ASCII other than letters counts as one space; the other bytes stay.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[:65] = _FOLD[91:97] = _FOLD[123:128] = 32


def suffix_automaton(text: bytes) -> list[dict[int, int]]:
    """Transitions of the least automaton of all substrings of the text; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, length = [-1], [0]
    last = 0
    for byte in text:
        state = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and byte not in moves[at]:
            moves[at][byte] = state
            at = link[at]
        if at >= 0:
            target = moves[at][byte]
            if length[target] == length[at] + 1:
                link[state] = target
            else:  # the target also ends longer substrings: split it
                copy = len(moves)
                moves.append(dict(moves[target]))
                length.append(length[at] + 1)
                link.append(link[target])
                while at >= 0 and moves[at].get(byte) == target:
                    moves[at][byte] = copy
                    at = link[at]
                link[target] = link[state] = copy
        last = state
    return moves


def fold(data: np.ndarray) -> np.ndarray:
    return _FOLD[data]


def displaced(moves: list[dict[int, int]]) -> tuple[list[int], int]:
    """A place for each state, all different, so that no two transitions have the same
    place + byte; and the size of the table that holds them."""
    size = 2 * sum(map(len, moves)) + 1024
    taken, based = bytearray(size), bytearray(size)
    places, low, width = [0] * len(moves), 0, 256
    for state in sorted(range(len(moves)), key=lambda s: -len(moves[s])):
        row = list(moves[state]) or [0]
        if len(row) < width:  # smaller rows fit where larger ones did not
            low, width = 0, len(row)
        slot, tries = taken.find(0, low), 0
        while True:
            if slot < 0 or slot + 512 > len(taken):
                taken.extend(bytes(1 << 16))
                based.extend(bytes(1 << 16))
                slot = taken.find(0, max(low, slot))
            place = slot - row[0]
            if place >= 0 and not based[place] and not any(taken[place + byte] for byte in row):
                break
            slot, tries = taken.find(0, slot + 1), tries + 1
        low = slot if tries > 100 else low
        places[state] = place
        based[place] = 1
        for byte in moves[state]:
            taken[place + byte] = 1
    return places, max(max(places) + 256, taken.rfind(1) + 1)


class Parser:
    """Sparse automata of all languages in one table.

    A state is a place in the table. Entry [state + byte] holds a state, whose transition it is,
    and the next one. Where it is another's no phrase goes on, and `restart` has the state that
    the byte leads to from the language's start: a new phrase. A byte that a language has not is
    a phrase by itself. Of languages that cost the same, the one named first in `texts` wins.
    """

    def __init__(self, texts: dict[str, list[bytes]]):
        self.languages = list(texts)
        self.texts: dict[str, bytes] = {}  # as learned
        tables, self.starts, self.bits, self.strange, restart, base = [], [], [], [], [], 0
        for name in self.languages:
            text = fold(np.frombuffer(b" ".join(texts[name])[:TEXT_BYTES], np.uint8))
            self.texts[name] = text.tobytes()
            moves = suffix_automaton(self.texts[name])
            self.strange.append(np.array([byte not in moves[0] for byte in range(256)]))
            moves[0] = {byte: moves[0].get(byte, 0) for byte in range(256)}
            places, size = displaced(moves)
            at = np.array(places, np.int64) + base
            owner = np.repeat(at, [len(row) for row in moves])
            byte = np.array([x for row in moves for x in row], np.int64)
            after = at[[x for row in moves for x in row.values()]]
            table = np.full(size, -1, np.int64)
            table[owner + byte - base] = owner << 32 | after
            tables.append(table)
            self.starts.append(int(at[0]))
            restart.append(table[places[0] : places[0] + 256] & 0xFFFFFFFF)
            self.bits.append(np.log2(max(2, len(text))))
            base += size
        self.table = np.concatenate(tables) if tables else np.zeros(0, np.int64)
        self.restart = np.concatenate(restart) if restart else np.zeros(0, np.int64)

    def phrases(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases by text and language."""
        n, k = len(offsets) - 1, len(self.languages)
        size = np.diff(offsets)
        pieces = -(-size // _STEP)
        owner = np.repeat(np.arange(n), pieces)
        out = np.zeros((n, k))
        if not len(owner):
            return out
        nth = np.arange(len(owner)) - (np.cumsum(pieces) - pieces)[owner]
        begin = offsets[:-1][owner] + nth * _STEP
        length = np.minimum(size[owner] - nth * _STEP, _STEP)
        follows = np.flatnonzero(nth)  # pieces with one before them, which is the one at the left
        ends = np.cumsum(pieces)[pieces > 0] - 1
        codes = fold(data)
        step = max(1, _AT_ONCE // len(owner))
        for low in range(0, k, step):
            some = range(low, min(k, low + step))
            starts = np.array(self.starts[low : low + step], np.int64)[:, None]
            first = np.array(some, np.int64)[:, None] * 256

            def run(which: np.ndarray, state: np.ndarray, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
                """States and ended phrases of these pieces after their bytes a to b."""
                order = np.argsort(-length[which], kind="stable")
                where, sizes = begin[which][order], length[which][order]
                alive = len(sizes) - np.searchsorted(sizes[::-1], np.arange(a, b), "right")
                state, count = state[:, order], np.zeros(state.shape, np.int64)
                for i in range(a, min(b, int(sizes[0]))):
                    m = int(alive[i - a])
                    byte = codes[where[:m] + i].astype(np.int64)
                    at = state[:, :m]
                    now = self.table.take(at + byte)
                    ended = now >> 32 != at
                    count[:, :m] += ended
                    now &= 0xFFFFFFFF
                    np.copyto(now, self.restart.take(first + byte), where=ended)
                    state[:, :m] = now
                back = np.argsort(order)
                return state[:, back], count[:, back]

            every = np.arange(len(owner))
            begun = np.repeat(starts, len(owner), 1)  # the states that the pieces were parsed from
            states, counts, at = [], [], begun
            for a, b in zip(_CHECKS, _CHECKS[1:]):
                at, count = run(every, at, a, b)
                states.append(at.copy())
                counts.append(count)
            todo = follows
            while len(todo):
                todo = todo[(states[-1][:, todo - 1] != begun[:, todo]).any(0)]
                if not len(todo):
                    break
                begun[:, todo] = at = states[-1][:, todo - 1]
                going = todo
                for nr, (a, b) in enumerate(zip(_CHECKS, _CHECKS[1:])):
                    at, counts[nr][:, going] = run(going, at, a, b)
                    other = (at != states[nr][:, going]).any(0)
                    states[nr][:, going] = at
                    going, at = going[other], at[:, other]  # the others go on as they did before
                    if not len(going):
                        break
                todo = np.intersect1d(going + 1, follows)  # whose left neighbour ends otherwise now
            whole = sum(counts)
            whole[:, ends] += states[-1][:, ends] != starts  # with the phrase still open at a text's end
            for j in some:
                strange = np.diff(np.searchsorted(np.flatnonzero(self.strange[j][codes]), offsets))
                out[:, j] = np.bincount(owner, weights=whole[j - low], minlength=n) + strange
        return out

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language by text, and its share among 2 ** -cost."""
        cost = self.phrases(data, offsets) * np.array(self.bits)
        best = cost.argmin(1)
        share = np.exp2(-np.minimum(cost - cost.min(1, keepdims=True), 1000)).sum(1)
        return best, 1 / share


def agreeing(texts: dict[str, list[bytes]]) -> dict[str, list[bytes]]:
    """The passages whose label holds when automata of the other half of the passages read them:
    a passage under a wrong label, or a copy of one, would draw whole texts to that language.
    Where that would leave a language without passages, all of its stay."""
    halves = [{k: [x for i, x in enumerate(v) if i % 2 == half] for k, v in texts.items()} for half in (0, 1)]
    kept: dict[str, list[bytes]] = {k: [] for k in texts}
    for half in (0, 1):
        other = Parser({k: v for k, v in halves[1 - half].items() if v})
        for name, passages in halves[half].items():
            if not passages or len(other.languages) < 2:
                kept[name] += passages
                continue
            data = np.frombuffer(b"".join(passages), np.uint8)
            best, _ = other.predict(data, np.concatenate([[0], np.cumsum([len(x) for x in passages])]))
            kept[name] += [x for x, k in zip(passages, best, strict=True) if other.languages[k] == name]
    return {k: kept[k] or v for k, v in texts.items()}


def fit(docs: DataFrame, *, text: str = "text", key: str = "doc_id", lang: str = "lang", passages: int = PASSAGES,
        passage_chars: int = PASSAGE_CHARS) -> Parser:
    """Automata of the languages of these labelled documents."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    counts = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return Parser({})
    spread = 1 << 30
    below = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], int(min(1.0, passages / r["count"]) * spread))])
    draw = F.xxhash64(F.col("key"), F.col("text"), F.lit("passage"))
    chosen = rows.withColumn("draw", draw).where(F.pmod("draw", F.lit(spread)) < F.coalesce(F.try_element_at(below, F.col("lang")), F.lit(0)))
    place = F.pmod(F.shiftright("draw", 31), F.greatest(F.length("text") - passage_chars, F.lit(1))).cast("int") + 1
    passage = F.substring("text", place, F.lit(passage_chars))
    # equal rows are drawn together and count once, so these are about `passages` a language
    found = chosen.select("lang", "draw", F.lower(passage).alias("t")).distinct().collect()
    texts: dict[str, list[bytes]] = {r["lang"]: [] for r in counts}
    for r in sorted(found, key=lambda r: (r["lang"], r["draw"], r["t"])):
        if (passage := r["t"].encode()) not in texts[r["lang"]]:
            texts[r["lang"]].append(passage)
    return Parser(agreeing({k: v for k, v in texts.items() if v}))


def _has_letter(data: np.ndarray, offsets: np.ndarray, texts: pa.Array) -> np.ndarray:
    ascii_letter = _FOLD[data] != 32
    ascii_letter &= data < 128
    out = np.zeros(len(offsets) - 1, bool)
    filled = np.diff(offsets) > 0
    if filled.any():
        out[filled] = np.logical_or.reduceat(ascii_letter, offsets[:-1][filled])
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in texts[int(i)].as_py())
    return out


def identify(docs: DataFrame, parser: Parser, *, text: str = "text", keep: list[str] | None = None,
             name: str = "lang_pred", score: str = "score") -> DataFrame:
    """The `keep` columns of the documents (default: all) with the language and its score."""
    keep = docs.columns if keep is None else keep
    fields = [docs.schema[c] for c in keep if c not in (name, score)]
    schema = T.StructType([*fields, T.StructField(name, T.StringType()), T.StructField(score, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(parser)  # grows with the languages only

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        learned: Parser = shared.value
        names = np.array([*learned.languages, "und"], object)
        tile = _TILE * 8 // max(8, len(learned.languages))
        for batch in batches:
            column = batch.column(text)
            found, shares = [np.zeros(0, np.int64)], [np.zeros(0)]
            _, offsets = utf8_buffers(column)
            for a, b in tiles(offsets, tile):
                part = pc.utf8_lower(column.slice(a, b - a))
                data, at = utf8_buffers(part)
                letters = _has_letter(data, at, part) & bool(learned.languages)
                best, share = learned.predict(data, at) if learned.languages else (np.zeros(b - a, np.int64), np.zeros(b - a))
                found.append(np.where(letters, best, len(names) - 1))
                shares.append(np.where(letters, share, 0.0))
            own = [batch.column(f.name) for f in fields]
            yield pa.RecordBatch.from_arrays([*own, pa.array(names[np.concatenate(found)], pa.string()), pa.array(np.concatenate(shares))], names=schema.names)

    return docs.mapInArrow(run, schema)
