"""Bradley-Terry quality ranking of documents.

A document's features are shares of bytes and of simple shapes of its words and lines. Pairs
of a good and a bad training document give feature differences, and logistic loss on those
(Bradley-Terry) gives a weight vector w; w.x ranks documents. The cut is the quantile of the
training scores that the share of bad labels names; a score is sigmoid(w.x - cut).

The model is fitted on the driver on a sample of labelled documents, about `max_rows` (drawn by
hash of the id; their features are 270-odd numbers a row) and never more than twice as many. Scoring is one pass over
the whole texts without a shuffle.

Null and empty texts have the features of an empty text and get its score. Labelled rows with
a null label or id, or without a document, teach nothing; rows with the same label and equal
features count once. Without labels of both kinds every document is kept (score 0.5). Columns of the
documents with the name of a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import words as W
from tessera.llm.common import sample_share, tiles, utf8_buffers

MAX_ROWS, MAX_PAIRS = 6000, 40_000

#: Bytes with a feature of their own; the rest count through their classes.
_BYTES = 256
_SHAPES = 16
#: A text of n bytes counts n / (n + DAMPING): shares of a few words say little.
DAMPING = 64


_SPACE, _UPPER, _LETTER = np.zeros((3, 256), bool)
_SPACE[[9, 10, 32]] = _UPPER[65:91] = _LETTER[97:123] = _LETTER[128:] = True

#: A longer text is counted in pieces of this many bytes, which bounds the memory.
_PIECE = 1 << 23


def _counts(data: np.ndarray, offsets: np.ndarray, left: int = 32, right: int = 32) -> tuple[np.ndarray, np.ndarray]:
    """By text: counts of bytes, and of shapes. `left` and `right` are the bytes around a piece
    of a longer text; a text begins and ends as if between spaces."""
    n, size = len(offsets) - 1, np.diff(offsets)
    first, last = offsets[:-1][size > 0], offsets[1:][size > 0] - 1
    text = np.repeat(np.arange(n, dtype=np.int64), size)
    counts = np.bincount(text * 256 + data, minlength=n * 256).reshape(n, 256)
    before = np.empty_like(data)
    before[1:] = data[:-1]
    before[first] = left
    after = np.empty_like(data)
    after[:-1] = data[1:]
    after[last] = right
    space, upper = _SPACE[data], _UPPER[data]
    letter = upper | _LETTER[data]
    begin, end = ~space & _SPACE[before], ~space & _SPACE[after]
    # a text's first byte repeats nothing, whatever its left neighbour is
    inside = np.ones(len(data), bool)
    if left == 32:
        inside[first] = False
    pair, capital = (data == before) & ~letter & inside, upper & _UPPER[before]
    total = lambda flags: np.add.reduceat(np.append(flags, False).astype(np.int64), np.minimum(offsets[:-1], len(data))) * (size > 0)
    shapes = (begin & ~letter, end & ~letter, begin & upper, begin & end, pair, capital, upper, ~letter & ~space, space, letter, data == 10, begin)
    return counts, np.array([total(x) for x in shapes])


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row for each text: square roots of byte shares, shares of shapes, and its damping."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    out = np.zeros((n, _BYTES + _SHAPES + 1))
    if not len(data):
        return out
    if n == 1 and len(data) > _PIECE:
        edges = [*range(0, len(data), _PIECE), len(data)]
        around = lambda at: int(data[at]) if 0 <= at < len(data) else 32
        # the left neighbour is one that says whether it was there: a space does not count as one
        parts = [_counts(data[a:b], np.array([0, b - a]), around(a - 1), around(b)) for a, b in zip(edges, edges[1:])]
        counts, shapes = sum(c for c, _ in parts), sum(x for _, x in parts)
        shapes[_PAIR] += sum(1 for a in edges[1:-1] if data[a] == data[a - 1] == 32)
    else:
        counts, shapes = _counts(data, offsets)
    some = np.maximum(size, 1)
    out[:, :_BYTES] = np.sqrt(counts / some[:, None])
    words, lines = np.maximum(shapes[-1], 1), shapes[-2] + 1
    tokens, at = W.text_words(data, offsets)
    owner = np.repeat(np.arange(n), np.diff(at))
    n_tokens = np.maximum(np.diff(at), 1)
    again = []  # words that stand 1, 2 or 3 words before as well
    for lag in (1, 2, 3):
        same = np.zeros(len(tokens), bool)
        same[lag:] = (tokens[lag:] == tokens[:-lag]) & (owner[lag:] == owner[:-lag])
        again.append(np.bincount(owner[same], minlength=n))
    order = np.lexsort((tokens, owner))
    first = np.ones(len(tokens), bool)
    first[1:] = (tokens[order][1:] != tokens[order][:-1]) | (owner[order][1:] != owner[order][:-1])
    distinct = np.bincount(owner[order][first], minlength=n)
    columns = (*shapes[:-2], lines, words, *again, distinct)
    per = (words, words, words, words, words, words, some, some, some, some, words, some, n_tokens, n_tokens, n_tokens, n_tokens)
    for k, (count, base) in enumerate(zip(columns, per, strict=True)):
        out[:, _BYTES + k] = np.minimum(count / base, 4.0)
    out[:, -1] = size / (size + DAMPING)
    out[size == 0] = 0
    return out


#: The place among the shapes of bytes that are no letter and stand twice.
_PAIR = 4


@dataclass
class Model:
    """Scores are sigmoid(damping * (x - mean) . weights - cut)."""

    mean: np.ndarray
    weights: np.ndarray
    cut: float

    def score(self, x: np.ndarray) -> np.ndarray:
        # summed row by row, so that a text's score does not depend on its batch
        rank = (_centred(x, self.mean) * self.weights).sum(1)
        return 1 / (1 + np.exp(-np.clip(rank - self.cut, -30, 30)))


def _centred(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return (x[:, :-1] - mean) * x[:, -1:]


def bradley_terry(good: np.ndarray, bad: np.ndarray, *, pairs: int = MAX_PAIRS, ridge: float = 1.0, steps: int = 12) -> Model:
    """Newton's steps on logistic loss over differences of drawn (good, bad) pairs, with a ridge."""
    mean = np.concatenate([good, bad])[:, :-1].mean(0)
    good, bad = _centred(good, mean), _centred(bad, mean)
    both = np.concatenate([good, bad])
    spread = both.std(0)
    scale = np.where(spread > 0, 1 / np.maximum(spread, 1e-3), 0)
    draw = np.random.default_rng(1)
    n = min(pairs, len(good) * len(bad) * 4)
    x = (good[draw.integers(len(good), size=n)] - bad[draw.integers(len(bad), size=n)]) * scale
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (1 - p) - ridge * w
        hessian = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hessian, gradient)
        w += step
        if np.abs(step).max() < 1e-4:
            break
    weights = w * scale
    scores = np.sort((both * weights).sum(1))
    k = len(bad)  # the quantile at the share of bad rows, between its neighbours
    return Model(mean, weights, float((scores[k - 1] + scores[min(k, len(scores) - 1)]) / 2))


def fit(docs: DataFrame, labels: DataFrame, *, text: str = "text", key: str = "doc_id", label: str = "quality", max_rows: int = MAX_ROWS) -> Model | None:
    """A model from about max_rows labelled documents; None where one kind of label is absent."""
    spark = docs.sparkSession
    known = labels.select(F.col(key).alias("__key"), F.col(label).alias("__label")).where("__key is not null and __label is not null")
    known = known.distinct()  # repeated rows are summed up where they lie
    rows = known.count()
    if not rows:
        return None
    taken = known.where(sample_share(max_rows / rows, F.col("__key"))) if rows > max_rows else known
    wanted = spark.createDataFrame(taken.limit(2 * max_rows).collect(), taken.schema)
    sample = docs.select(F.col(key).alias("__key"), F.col(text).alias("text")).join(F.broadcast(wanted), "__key").select("__label", "text")
    schema = T.StructType([T.StructField("label", T.IntegerType()), T.StructField("x", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_buffers(batch.column(1))
            x = [row.tobytes() for a, b in tiles(offsets) for row in features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int32()), pa.array(x, pa.binary())], names=["label", "x"])

    found = sample.mapInArrow(run, schema).distinct().limit(2 * max_rows).collect()  # an id may have many rows
    found.sort(key=lambda r: (r.label, r.x))
    good, bad = ([np.frombuffer(r.x) for r in found if (r.label > 0) == kind] for kind in (True, False))
    if not good or not bad:
        return None
    return bradley_terry(np.array(good), np.array(bad))


def score(docs: DataFrame, model: Model | None, *, text: str = "text", keep: list[str] | None = None, name: str = "score") -> DataFrame:
    """The `keep` columns of the documents (default: all) with their score."""
    keep = docs.columns if keep is None else keep
    if model is None:
        return docs.select(*[c for c in keep if c != name], F.lit(0.5).alias(name))
    fields = [docs.schema[c] for c in keep if c != name]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*fields, T.StructField(name, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8_buffers(batch.column(text))
            parts = [shared.value.score(features(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in tiles(offsets)]
            scores = np.concatenate(parts) if parts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], pa.array(scores)], names=schema.names)

    return docs.mapInArrow(run, schema)


def passes(score_column: Column) -> Column:
    return score_column >= 0.5


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that a model of these labels does not reject, with their own columns."""
    scored = score(docs, fit(docs, labels, **options), text=options.get("text", "text"), name="__score")
    return scored.where(passes(F.col("__score"))).drop("__score")
