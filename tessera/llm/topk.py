"""Exact top-k by inner product with a pivot-distance index.

Vectors become integers, floor(1024 x). With one more coordinate, sqrt(M - |x|^2) for the
largest squared norm M, the nearest vectors of a query (whose added coordinate is 0) are those
of the highest inner product: distance^2 = M + |q|^2 - 2 q.x. Each vector is keyed by its
nearest pivot and its distance from it, cut into rings of equal width; the index is the
vectors sorted by that key, in blocks of at most `block_rows` of one ring. Pivots and rings
follow the number of rows; neighbouring blocks of a ring, at most `BLOCKS_PER_KEY`, are an annulus.

A search first visits the ring that holds the query, which gives a bound on its k-th score
and so a radius r; then, pivot by pivot, it expands to the rings that hold any distance
within r of the query's own. By the triangle inequality no other ring has a better vector.
Queries go to the rings in packets, sorted by distance; a packet meets only the annuli within
the reach of its queries, and in them the blocks. An annulus is a key of the join, so a task
meets a bounded number of blocks of a key, whatever share of the vectors one ring holds.

The pivots come from about `sample_rows` vectors, drawn by hash of id and vector, and never more
than four times as many; all vectors are indexed. Scores are exact integers.

Rows with a null id, a null or empty vector, or a null or non-finite component take no part.
Vectors shorter than the longest are filled up with zeros. Repeated rows are rows each, as in a
join of queries and candidates on different ids: a candidate row comes as often as it is there,
the results of all query rows of one id are ranked together, and rows of one id are never each
other's results. Other columns are ignored; an empty table, or one without queries, gives an
empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.common import discard, sample_share, stored

#: The least number of pivots and of rings of a pivot, and the most to which they grow.
PIVOTS, RINGS, MOST_PIVOTS, MOST_RINGS = 16, 8, 64, 48
SAMPLE_ROWS, BLOCK_ROWS, PACKET_ROWS, BLOCKS_PER_KEY = 2048, 2048, 256, 64
#: Pairs of query and ring that are put out at once.
_PAIRS = 1 << 15
#: Rows that Python gets at once where a row holds a packet and a block.
MEETING_ROWS = 8
#: Whatever lies farther out than the sample did is in the last ring, which has no outer bound.
LAST_RING = 63


def integers(vectors: DataFrame, key: str, vector: str, scale: int = 1024) -> DataFrame:
    """id and v (array of long) of the rows that take part."""
    v = F.col(vector)
    sound = F.col(key).isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.coalesce(sound, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale)).alias("v"))


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Centres of a few rounds of k-means that starts from far apart vectors."""
    distinct = np.unique(sample, axis=0)
    centres = [distinct[0]]
    nearest = ((distinct - centres[0]) ** 2).sum(1)
    while len(centres) < min(count, len(distinct)):
        centres.append(distinct[int(nearest.argmax())])
        nearest = np.minimum(nearest, ((distinct - centres[-1]) ** 2).sum(1))
    pivots = np.array(centres)
    for _ in range(8):
        owner = _distances(sample, pivots).argmin(1)
        for k in range(len(pivots)):
            if (own := sample[owner == k]).size:
                pivots[k] = own.mean(0)
    return pivots


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists of integers as rows of doubles, filled up with zeros."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(lengths) and (lengths == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(lengths), width))
    row = np.repeat(np.arange(len(lengths)), lengths)
    at = np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[row, at] = values
    return out


class Space:
    """Pivots, ring width and the largest squared norm: what every task needs."""

    def __init__(self, pivots: np.ndarray, step: float, top: float, width: int):
        self.pivots, self.step, self.top, self.width = pivots, step, top, width

    def lifted(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.top - (x * x).sum(1), 0))])

    def query_distances(self, x: np.ndarray) -> np.ndarray:
        return _distances(np.column_stack([x, np.zeros(len(x))]), self.pivots)

    def slack(self) -> float:
        """More than the rounding of any distance here."""
        return 1e-6 * (1 + np.sqrt(self.top))


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products: by doubles where every sum stays below 2^53."""
    if not a.size or not b.size or np.abs(a).max() * np.abs(b).max() * a.shape[1] < 2.0**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k highest scores, ties to the smaller id."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        kept = np.flatnonzero(scores >= least)
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((ids[kept], -scores[kept]))[:k]]


_BLOCK = "pivot int, ring int, annulus long, low double, high double, n int, ids binary, vectors binary"


def grid(rows: int, block_rows: int = BLOCK_ROWS) -> tuple[int, int]:
    """Pivots and rings for so many vectors: rings of about one annulus, within the limits."""
    pivots = min(MOST_PIVOTS, max(PIVOTS, math.isqrt(rows // block_rows)))
    return pivots, min(MOST_RINGS, max(RINGS, rows // (pivots * BLOCKS_PER_KEY * block_rows)))


def build(vectors: DataFrame, *, pivots: int | None = None, rings: int | None = None, sample_rows: int = SAMPLE_ROWS, block_rows: int = BLOCK_ROWS,
          blocks_per_key: int = BLOCKS_PER_KEY, into: list[str] | None = None) -> tuple[DataFrame, Space] | None:
    """The blocks of the index, stored, and its space; None of no vectors. Takes id and v."""
    spark = vectors.sparkSession
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    rows, top, width = vectors.agg(F.count("*"), F.max(norm), F.max(F.size("v"))).first()
    if not rows:
        return None
    pivots, rings = pivots or grid(rows, block_rows)[0], rings or grid(rows, block_rows)[1]
    chosen = vectors.where(sample_share(min(1.0, sample_rows / rows), F.col("id"), F.col("v"))) if rows > sample_rows else vectors
    sample = [r["v"] for r in chosen.limit(4 * sample_rows).collect()] or [vectors.first()["v"]]
    sample.sort()
    space = Space(np.zeros((1, width + 1)), 1.0, top, width)
    lifted = space.lifted(np.array([[*v, *[0] * (width - len(v))] for v in sample], float))
    space.pivots = choose_pivots(lifted, pivots)
    near = _distances(lifted, space.pivots).min(1)
    space.step = max(1.0, (near.max() - near.min()) / rings)
    shared = spark.sparkContext.broadcast(space)

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            x = _matrix(batch.column("v"), s.width)
            d = _distances(s.lifted(x), s.pivots)
            owner, near = d.argmin(1).astype(np.int32), d.min(1)
            packed = [row.tobytes() for row in x.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(owner), pa.array(np.minimum(near // s.step, LAST_RING).astype(np.int32)), pa.array(near), batch.column("id"), pa.array(packed, pa.binary())], names=["pivot", "ring", "distance", "id", "v"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of equal (pivot, ring) of the sorted rows; so many of them in turn are an annulus."""
        key, ids, vs, ds = None, [], [], []
        annulus, held = TaskContext.get().partitionId() << 33, 0

        def block() -> pa.RecordBatch:
            values = [*key, annulus, min(ds), max(ds), len(ids), np.array(ids, np.int64).tobytes(), b"".join(vs)]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.int32(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=["pivot", "ring", "annulus", "low", "high", "n", "ids", "vectors"])

        for batch in batches:
            for pivot, ring, d, i, v in zip(*[batch.column(c).to_pylist() for c in ("pivot", "ring", "distance", "id", "v")], strict=True):
                changed = (pivot, ring) != key
                if ids and (changed or len(ids) >= block_rows):
                    yield block()
                    held += 1
                    if changed or held >= blocks_per_key:
                        annulus, held = annulus + 1, 0
                    ids, vs, ds = [], [], []
                key = pivot, ring
                ids.append(i)
                vs.append(v)
                ds.append(d)
        if ids:
            yield block()

    order = ["pivot", "ring", "distance", "id", "v"]
    sorted_rows = vectors.mapInArrow(keyed, "pivot int, ring int, distance double, id long, v binary").repartitionByRange(*order).sortWithinPartitions(*order)
    return stored(sorted_rows.mapInArrow(blocks, _BLOCK), "topk-index", into=into), space


_QUERY = "pivot int, ring int, qid long, qv binary, distance double, bound long, radius double"
_HIT = "query_id long, qv binary, vec_id long, score long"


def _gathered(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """The rows in batches of at least so many, but for the last; Spark's own may be tiny here."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= least:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _expand(queries: DataFrame, shared, rings: list[tuple[int, int, float, float]], first: bool) -> DataFrame:
    """(pivot, ring) to visit for each query (qid, qv, bound): its home at first, and then all
    others that its radius reaches. `rings`: those that hold vectors, with their distances."""
    pivot, ring, low, high = (np.array(x) for x in zip(*rings, strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        step = max(1, _PAIRS // len(pivot))
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                x = np.array([np.frombuffer(v, np.int64) for v in part.column("qv").to_pylist()], float).reshape(part.num_rows, s.width)
                bound = part.column("bound")
                least = bound.fill_null(0).to_numpy(zero_copy_only=False).astype(float)
                radius = np.sqrt(np.maximum(s.top + (x * x).sum(1) - 2.0 * least, 0)) + s.slack()
                radius[bound.is_null().to_numpy(zero_copy_only=False)] = np.inf
                d = s.query_distances(x)[:, pivot]
                home = np.abs((low + high) / 2 - d).argmin(1)
                if first:
                    query, place = np.arange(part.num_rows), home
                else:
                    reached = np.maximum(low - d, d - high) <= radius[:, None] + s.slack()
                    reached[np.arange(part.num_rows), home] = False
                    query, place = np.nonzero(reached)
                own = part.take(pa.array(query))
                columns = [pa.array(pivot[place], pa.int32()), pa.array(ring[place], pa.int32()), own.column("qid"), own.column("qv"), pa.array(d[query, place]), own.column("bound"), pa.array(radius[query])]
                yield pa.RecordBatch.from_arrays(columns, names=["pivot", "ring", "qid", "qv", "distance", "bound", "radius"])

    return queries.mapInArrow(run, _QUERY)


def _visit(wanted: DataFrame, index: DataFrame, annuli: DataFrame, shared, k: int) -> DataFrame:
    """The best k of each visited block for each query that the block can still help."""
    members = ["qid", "qv", "distance", "bound", "radius"]

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted rows to packets of at most PACKET_ROWS queries of one ring, with their reach."""
        for batch in _gathered(batches, 16 * PACKET_ROWS):
            pivot, ring, distance, radius = (batch.column(c).to_numpy() for c in ("pivot", "ring", "distance", "radius"))
            runs = [0, *(np.flatnonzero((np.diff(pivot) != 0) | (np.diff(ring) != 0)) + 1), batch.num_rows]
            begin = np.concatenate([np.arange(a, b, PACKET_ROWS) for a, b in zip(runs, runs[1:])])
            rows = pa.StructArray.from_arrays([batch.column(c) for c in members], members)
            lists = pa.ListArray.from_arrays(pa.array([*begin, batch.num_rows], pa.int32()), rows)
            reach = [pa.array(x) for x in (np.minimum.reduceat(distance - radius, begin), np.maximum.reduceat(distance + radius, begin))]
            yield pa.RecordBatch.from_arrays([pa.array(pivot[begin]), pa.array(ring[begin]), lists, *reach], names=["pivot", "ring", "members", "from", "to"])

    schema = "pivot int, ring int, members array<struct<qid:long,qv:binary,distance:double,bound:long,radius:double>>, from double, to double"
    order = ["pivot", "ring", "distance", "qid", "qv"]  # by range, so the queries of a hot ring lie in many tasks and packets are full
    gathered = wanted.repartitionByRange(*order).sortWithinPartitions(*order).select("pivot", "ring", *members).mapInArrow(packed, schema)
    slack = shared.value.slack()
    gathered = gathered.join(annuli, ["pivot", "ring"]).where((F.col("low") <= F.col("to") + slack) & (F.col("high") >= F.col("from") - slack))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = shared.value
        for batch in batches:
            found: list[tuple] = []
            for row in range(batch.num_rows):
                qid, qv, distance, bound, radius = batch.column("members")[row].values.flatten()
                low, high, ids, vectors = (batch.column(c)[row].as_py() for c in ("low", "high", "ids", "vectors"))
                distance, radius = distance.to_numpy(), radius.to_numpy() + s.slack()
                near = np.flatnonzero((low <= distance + radius) & (high >= distance - radius))
                if not len(near):
                    continue
                own = np.frombuffer(ids, np.int64)
                x = np.frombuffer(vectors, np.int64).reshape(-1, s.width).astype(np.float64)
                names, texts, bounds = (c.take(pa.array(near)).to_pylist() for c in (qid, qv, bound))
                q = np.array([np.frombuffer(v, np.int64) for v in texts], float)
                for name, text, least, scores in zip(names, texts, bounds, _products(q, x), strict=True):
                    open_ = own != name
                    if least is not None:
                        open_ &= scores >= least
                    at = np.flatnonzero(open_)
                    at = at[best_of(scores[at], own[at], k)]
                    found += [(name, text, int(own[j]), int(scores[j])) for j in at]
            columns = list(zip(*found, strict=True)) or [[] for _ in range(4)]
            types = [pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["query_id", "qv", "vec_id", "score"])

    met = gathered.select("annulus", "members").join(index, "annulus").select("members", "low", "high", "ids", "vectors")
    return met.mapInArrow(search, _HIT)


def search(vectors: DataFrame, is_query: Column, k: int, *, key: str = "vec_id", vector: str = "embedding", **options) -> DataFrame:
    """query_id, rank, vec_id and score of the k best of every row for which is_query(id) holds;
    `is_query` is a condition on the column id."""
    spark = vectors.sparkSession
    rows = integers(vectors, key, vector)
    tables: list[str] = []
    built = build(rows, into=tables, **options)
    if built is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    index, space = built
    shared = spark.sparkContext.broadcast(space)
    annuli = stored(index.groupBy("pivot", "ring", "annulus").agg(F.min("low").alias("low"), F.max("high").alias("high")), "topk-annuli", into=tables)
    held = annuli.groupBy("pivot", "ring").agg(F.min("low"), F.max("high"))
    rings = [tuple(r) for r in held.orderBy("pivot", "ring").collect()]  # at most pivots x (LAST_RING + 1) rows

    queries = rows.where(is_query)
    width = space.width

    def wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [row.tobytes() for row in _matrix(batch.column("v"), width).astype(np.int64)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(packed, pa.binary())], names=["qid", "qv"])

    # equal query rows ask once; their results count as often as they are there
    times = queries.mapInArrow(wide, "qid long, qv binary").groupBy("qid", "qv").agg(F.count("*").alias("times"))
    asked = stored(times.withColumn("bound", F.lit(None).cast("long")), "topk-queries", into=tables)
    seeds = stored(_visit(_expand(asked, shared, rings, True), index, annuli, shared, k), "topk-seeds", MEETING_ROWS, tables)
    best = Window.partitionBy("query_id", "qv").orderBy(F.desc("score"), "vec_id")
    ranked = seeds.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    bounds = ranked.where(F.col("rank") == k).select(F.col("query_id").alias("qid"), "qv", F.col("score").alias("bound"))
    bounded = asked.select("qid", "qv").join(bounds, ["qid", "qv"], "left")
    rest = stored(_visit(_expand(bounded, shared, rings, False), index, annuli, shared, k), "topk-rest", MEETING_ROWS, tables)
    found = ranked.drop("rank").unionByName(rest)
    again = asked.where("times > 1").select(F.col("qid").alias("query_id"), "qv", F.least("times", F.lit(k)).alias("times"))
    more = found.join(again, ["query_id", "qv"]).withColumn("nth", F.explode(F.sequence(F.lit(2).cast("long"), "times"))).select(found.columns)
    together = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    final = found.unionByName(more).withColumn("rank", F.row_number().over(together)).where(F.col("rank") <= k)
    out = stored(final.select("query_id", "rank", "vec_id", "score"), "topk")
    discard(spark, tables)
    return out
