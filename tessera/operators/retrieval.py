"""Character n-gram TF-IDF retrieval and recall at K.

Weights in long form, one row for each entity and gram, come from joins and aggregations. The
product of queries and targets is taken in blocks: targets are fitted once, as stored postings
of some thousand targets a row, and packets of queries meet them and keep the k best of each.
So neither the products nor a gram's postings are ever rows of a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.metrics import ratio
from tessera.functions.text import char_ngrams
from tessera.sources.shared import discard, stored

MIN_DF, MAX_DF, SCORE_DIGITS = 2, 0.05, 6


def gram_counts(entities: DataFrame, low: int, high: int, text: str = "norm_name") -> DataFrame:
    """entity_id, country, gram and tf. Names are shuffled, not grams: those of one entity are
    counted where its name lies."""
    partitions = int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    folded = F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s\s+", " ")
    named = entities.select("entity_id", "country", folded.alias("name")).repartition(partitions, "entity_id")
    grams = named.select("entity_id", "country", F.explode(char_ngrams(F.col("name"), low, high)).alias("gram"))
    return grams.groupBy("entity_id", "country", "gram").agg(F.count("*").alias("tf"))


def _vocabulary(counts: DataFrame, targets: DataFrame, min_df: int = MIN_DF, max_df: float = MAX_DF) -> DataFrame:
    """country, gram, df, idf, and n, the targets of the country."""
    sizes = targets.groupBy("country").agg(F.count("*").alias("n"))
    # counting by tf keeps that column, so the counts' exchange is the one that the weights use
    frequency = counts.groupBy("country", "gram").agg(F.count_if(F.col("tf") > 0).alias("df"))
    kept = frequency.join(sizes, "country").where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    return kept.select("country", "gram", "df", (F.log((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0).alias("idf"), "n")


def vocabulary(counts: DataFrame, targets: DataFrame, **limits) -> DataFrame:
    """country, gram, df and idf of the grams that enough and not too many targets have."""
    return _vocabulary(counts, targets, **limits).drop("n")


def weights(counts: DataFrame, words: DataFrame) -> DataFrame:
    """Weights of length 1 for each entity over the grams of the vocabulary."""
    raw = counts.join(words, ["country", "gram"]).withColumn("w", F.col("tf") * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("entity_id")))  # the grams of one name
    return raw.select("entity_id", "country", "gram", (F.col("w") / norm).alias("weight"))


#: Targets of a block and queries of a packet, on average and at most; cells of scores at once.
BLOCK_TARGETS, PACKET_QUERIES, CELLS = 4096, 2048, 1 << 20
#: Rows (entity, gram) after which a block or packet ends, whatever its key; meetings in Python at once.
_MOST_ROWS, _MEETINGS = 1 << 19, 4
_PACKED = "country string, part long, ids array<string>, grams array<string>, bounds binary, members binary, weights binary"


@dataclass
class Fitted:
    """Targets to search in, stored: their vocabulary and blocks of postings."""

    low: int
    high: int
    words: DataFrame
    blocks: DataFrame


def _packed(rows: DataFrame, by_gram: bool) -> DataFrame:
    """Rows (country, part, entity_id, gram, w) as sparse matrices, a row each, of weights of
    length 1: by gram (postings of a block) or by entity (a packet)."""

    def build(run: pa.Table) -> pa.RecordBatch:
        ids = run.column("entity_id").combine_chunks().dictionary_encode()
        grams = run.column("gram").combine_chunks().dictionary_encode()
        entity, gram = (x.indices.to_numpy().astype(np.int32) for x in (ids, grams))
        w = run.column("w").to_numpy()
        w = w / np.sqrt(np.bincount(entity, w * w))[entity]
        if by_gram:
            order = np.argsort(gram, kind="stable")
            sizes, members, w = np.bincount(gram), entity[order], w[order]
        else:
            sizes, members = np.bincount(entity), gram
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (ids.dictionary, grams.dictionary)]
        first = [run.column(c).slice(0, 1).combine_chunks() for c in ("country", "part")]
        return pa.RecordBatch.from_arrays([*first, *lists, *[pa.array([x.tobytes()], pa.binary()) for x in (bounds, members, w)]], names=["country", "part", "ids", "grams", "bounds", "members", "weights"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come sorted by key and entity; what one task holds is bounded by _MOST_ROWS."""
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [batch.column(c) for c in ("country", "part", "entity_id")]
            changed = np.zeros((2, batch.num_rows), bool)
            now = tuple(c[0].as_py() for c in keys)
            changed[:, 0] = last is not None and now[:2] != last[:2], last is not None and now != last
            for n, c in enumerate(keys):
                differs = pc.not_equal(c.slice(1), c.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
                changed[1, 1:] |= differs
                if n < 2:
                    changed[0, 1:] |= differs
            last = tuple(c[batch.num_rows - 1].as_py() for c in keys)
            begin, rows = 0, sum(b.num_rows for b in held)
            for at in np.flatnonzero(changed[1]):
                if changed[0, at] or rows + at - begin >= _MOST_ROWS:
                    yield build(pa.Table.from_batches([*held, batch.slice(begin, at - begin)]))
                    held, rows, begin = [], 0, at
            held.append(batch.slice(begin))
        if held:
            yield build(pa.Table.from_batches(held))

    dealt = rows.repartition("country", "part").sortWithinPartitions("country", "part", "entity_id")
    return dealt.select("country", "part", "entity_id", "gram", "w").mapInArrow(run, _PACKED)


def _weighted(counts: DataFrame, words: DataFrame, targets_a_part: int) -> DataFrame:
    raw = counts.join(words, ["country", "gram"])
    part = F.pmod(F.xxhash64("entity_id"), F.ceil(F.col("n") / targets_a_part))
    return raw.select("country", part.alias("part"), "entity_id", "gram", (F.col("tf") * F.col("idf")).alias("w"))


def fit(targets: DataFrame, low: int, high: int, *, into: list[str] | None = None, **limits) -> Fitted:
    """The targets once for all queries; the paths of the stored tables are added to `into`."""
    used: list[str] = []
    named = stored(targets.select("entity_id", "country", "norm_name"), "names", into=used)
    counts = gram_counts(named, low, high)
    words = stored(_vocabulary(counts, named, **limits), "vocabulary", into=into)
    blocks = stored(_packed(_weighted(counts, words, BLOCK_TARGETS), True), "targets", into=into)
    discard(targets.sparkSession, used)
    return Fitted(low, high, words, blocks)


def _meetings(met: DataFrame, k: int) -> DataFrame:
    """The k best targets of each block for each query of a packet: products are added up in
    dense rows of scores, of which CELLS are held at once."""
    array = lambda x, kind: np.frombuffer(x.as_buffer(), kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                get = lambda name: batch.column(name)[row]
                queries, targets = get("q_ids").values, get("ids").values
                n, size = len(queries), len(targets)
                place = pc.index_in(get("q_grams").values, value_set=get("grams").values).fill_null(-1).to_numpy()
                bounds, members, weights = array(get("bounds"), np.int64), array(get("members"), np.int32), array(get("weights"), np.float64)
                entry = place[array(get("q_members"), np.int32)]
                owner = np.repeat(np.arange(n), np.diff(array(get("q_bounds"), np.int64)))
                known = entry >= 0
                entry, owner, weight = entry[known], owner[known], array(get("q_weights"), np.float64)[known]
                step, kept = max(1, CELLS // size), min(k, size)
                found: list[tuple] = []
                for low in range(0, n, step):
                    a, b = np.searchsorted(owner, [low, low + step])
                    height = min(step, n - low)
                    lengths = bounds[entry[a:b] + 1] - bounds[entry[a:b]]
                    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths - bounds[entry[a:b]], lengths)
                    cell = np.repeat((owner[a:b] - low) * size, lengths) + members[at]
                    scores = np.bincount(cell, np.repeat(weight[a:b], lengths) * weights[at], height * size).reshape(height, size)
                    # rounded score and, against it, the rank of the id, as one whole number
                    order = np.floor(scores * 10**SCORE_DIGITS + 0.5).astype(np.int64) * size + np.arange(size - 1, -1, -1)
                    order[scores <= 0] = -1
                    best = np.partition(order, size - kept, axis=1)[:, size - kept :]
                    query, column = np.nonzero(best >= 0)
                    best = best[query, column]
                    found.append((query + low, size - 1 - best % size, best // size / 10**SCORE_DIGITS))
                query, target, score = (np.concatenate(x) for x in zip(*found, strict=True))
                country = pa.repeat(get("country"), len(query))
                yield pa.RecordBatch.from_arrays([queries.take(pa.array(query)), targets.take(pa.array(target)), country, pa.array(score)], names=["source1_entity_id", "target_entity_id", "country", "score"])

    return met.mapInArrow(run, "source1_entity_id string, target_entity_id string, country string, score double")


def search(queries: DataFrame, fitted: Fitted, k: int = 50) -> DataFrame:
    """The k best targets of each query within its country, by cosine; equal scores by id.

    Packets of queries meet every block of targets of their country. A meeting adds up its
    products and puts out k targets a query, so that nothing larger is shuffled, whatever the
    postings of a gram; the meetings of a country are dealt over as many keys as it has blocks."""
    used: list[str] = []
    counts = gram_counts(queries, fitted.low, fitted.high)
    packets = stored(_packed(_weighted(counts, fitted.words, 16 * BLOCK_TARGETS), False), "packets", into=used)
    names = {c: f"q_{c}" for c in ("ids", "grams", "bounds", "members", "weights")}
    parts = fitted.blocks.groupBy("country").agg(F.max("part").alias("last"))
    asked = packets.drop("part").withColumnsRenamed(names).join(parts, "country").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), "last")))
    met = asked.join(fitted.blocks, ["country", "part"]).select("country", *names.values(), *names)
    found = stored(_meetings(met, k), "meetings", _MEETINGS, used)
    best = Window.partitionBy("source1_entity_id").orderBy(F.desc("score"), "target_entity_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    out = stored(ranked.select(
        "source1_entity_id", "target_entity_id", F.split("target_entity_id", "-")[0].alias("target_source"), "country",
        F.lit(f"{fitted.low}_{fitted.high}").alias("ngram_config"), "score", "rank",
    ), "ranked")
    discard(queries.sparkSession, used)
    return out


def top_k(queries: DataFrame, targets: DataFrame, low: int, high: int, k: int = 50, **limits) -> DataFrame:
    """search() in targets that are fitted for this call alone."""
    used: list[str] = []
    out = search(queries, fit(targets, low, high, into=used, **limits), k)
    discard(queries.sparkSession, used)
    return out


def per_query(ranked: DataFrame, queries: DataFrame, truth: DataFrame, ks: list[int]) -> DataFrame:
    """For every query and K: candidates, right ones and true matches."""
    hits = truth.select("source1_entity_id", "target_entity_id", F.lit(1).alias("hit"))
    labeled = ranked.join(hits, ["source1_entity_id", "target_entity_id"], "left")
    at = labeled.select("source1_entity_id", "rank", "hit", F.explode(F.array(*map(F.lit, ks))).alias("k")).where(F.col("rank") <= F.col("k"))
    counts = at.groupBy("source1_entity_id", "k").agg(F.count("*").alias("cands"), F.count("hit").alias("tp"))
    wanted = truth.groupBy("source1_entity_id").agg(F.count("*").alias("total_gt"))
    every = queries.select(F.col("entity_id").alias("source1_entity_id"), "country", F.explode(F.array(*map(F.lit, ks))).alias("k"))
    return every.join(counts, ["source1_entity_id", "k"], "left").join(wanted, "source1_entity_id", "left").na.fill(0)


def recall_panel(rows: DataFrame, config: str, overall: str = "OVERALL", strict: bool = False) -> DataFrame:
    """Metrics by K, over all and for each country, in one pass with grouping sets. An entity is
    recovered if at least its true matches, with `strict` exactly as many, are found."""
    recovered = F.col("tp") == F.col("total_gt") if strict else F.col("tp") >= F.col("total_gt")
    cubed = rows.withColumn("grouping", F.explode(F.array(F.lit(overall), F.coalesce("country", F.lit("Unknown")))))
    s = cubed.groupBy("grouping", "k").agg(
        F.sum("tp").alias("tp"), F.sum("total_gt").alias("gt"), F.count_if(F.col("total_gt") > 0).alias("with_gt"),
        F.count_if((F.col("total_gt") > 0) & recovered).alias("complete"), F.sum("cands").alias("total_candidates"),
        F.avg("cands").alias("avg_candidates_per_s1"), F.median("cands").alias("median_candidates"), F.percentile("cands", 0.95).alias("p95_candidates"),
        F.percentile("cands", 0.99).alias("p99_candidates"), F.max("cands").alias("max_candidates"), F.count_if(F.col("cands") == 0).alias("zero_candidate_s1s"),
    )
    return s.select(
        F.lit(config).alias("ngram_config"), "grouping", "k", ratio(F.col("tp"), F.col("gt")).alias("pair_recall"), ratio(F.col("complete"), F.col("with_gt")).alias("s1_complete_recovery"),
        ratio(F.col("tp"), F.col("total_candidates")).alias("precision"), "total_candidates", "avg_candidates_per_s1", "median_candidates", "p95_candidates", "p99_candidates", "max_candidates", "zero_candidate_s1s",
    )


def overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    """Sizes of two candidate sets and of what they share."""
    keys = ["source1_entity_id", "target_entity_id"]
    marked = a.select(*keys, F.lit(1).alias("a")).join(b.select(*keys, F.lit(1).alias("b")), keys, "full")
    return marked.agg(F.count("a").alias("first"), F.count("b").alias("second"), F.count(F.col("a") + F.col("b")).alias("shared"))
