"""The named queries over the bound test tables, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as X
from tessera.operators import audit, evaluate, hardneg, retrieval, signals, split
from tessera.plans import views
from tessera.session import ship
from tessera.sources import shared, sinks, tables

KS = [5, 10, 20, 50]
#: Keys that more targets share are left out: the reference's threshold.
HEAVY = 100_000
SAMPLED = [("business_name",), ("norm_name",), ("business_address",), ("norm_addr",), ("norm_name", "norm_addr")]
VIEW_SQL = """
    WITH pairs AS (SELECT a.entity_id AS s1_id, t.entity_id AS target_id FROM s1_val a JOIN targets t ON a.country = t.country AND a.norm_name = t.norm_name AND a.norm_name != ''
                   UNION SELECT a.entity_id, t.entity_id FROM s1_val a JOIN targets t ON a.country = t.country AND a.norm_addr = t.norm_addr AND a.norm_addr != '')
    SELECT count(*) AS total_candidates, count(g.target_entity_id) AS tp, (SELECT sum(match_count) FROM gt_s1_val) AS wanted
    FROM pairs p LEFT JOIN gt_pairs g ON p.s1_id = g.source1_entity_id AND p.target_id = g.target_entity_id
"""


class Bound:
    """The tables of one folder, as lazy plans that are built when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = ship(spark)
        self.raw = tables.bound_records(spark, sf_dir)

    @property
    def records(self) -> DataFrame:
        return tables.normalized(self.raw)

    @property
    def s1(self) -> DataFrame:
        return tables.targets_of(self.records, "S1")

    @property
    def targets(self) -> DataFrame:
        return tables.targets_of(self.records)

    @property
    def lists(self) -> DataFrame:
        return tables.truth_lists(self.raw)

    @property
    def truth(self) -> DataFrame:
        return tables.truth_pairs(self.lists)

    @property
    def summary(self) -> DataFrame:
        return tables.truth_summary(self.lists, tables.targets_of(self.raw, "S1"))

    @property
    def split(self) -> DataFrame:
        return split.stratified_split(self.summary)

    @property
    def validation(self) -> DataFrame:
        return self.split.where("is_val").select("source1_entity_id")

    def s1_val(self) -> DataFrame:
        ids = self.validation.withColumnRenamed("source1_entity_id", "entity_id")
        return self.s1.join(ids, "entity_id", "left_semi")

    def truth_val(self) -> DataFrame:
        return self.truth.join(self.validation, "source1_entity_id", "left_semi")

    def names(self) -> DataFrame:
        """The five most frequent names of S1 and a name that is absent, as a list of names."""
        top = self.raw.where("source = 'S1'").groupBy("business_name").count().orderBy(F.desc("count"), "business_name").limit(5)
        return top.select(F.col("business_name").alias("name")).unionByName(self.spark.createDataFrame([("No Such Name LLC",)], "name string"))


def _per_s1(b: Bound, key: str, val: bool = False) -> DataFrame:
    signal = signals.SIGNALS[key]
    s1, summary = (b.s1_val(), b.summary.join(b.validation, "source1_entity_id", "left_semi")) if val else (b.s1, b.summary)
    return evaluate.per_entity(summary, evaluate.counts_of_signal(signal, s1, b.targets, b.truth))


def _panel(b: Bound, val: bool) -> DataFrame:
    n = b.raw.where("source <> 'S1'").count()
    s1, summary = (b.s1_val(), b.summary.join(b.validation, "source1_entity_id", "left_semi")) if val else (b.s1, b.summary)
    counts = evaluate.counts_of_signals(list(signals.SIGNALS.values()), s1, b.targets, b.truth)
    every = summary.withColumn("signal", F.explode(F.array(*map(F.lit, signals.SIGNALS))))
    rows = evaluate.panel(evaluate.per_entity(every, counts), n, by="signal", split="val" if val else "full")
    return rows.withColumnRenamed("signal", "key")


def _candidates(b: Bound, key: str) -> DataFrame:
    return signals.candidates(signals.SIGNALS[key], b.s1, b.targets)


def _ranked(b: Bound, low: int, high: int, k: int = 50) -> DataFrame:
    return retrieval.top_k(b.s1_val(), b.targets, low, high, k)


def _recall(b: Bound, low: int, high: int) -> DataFrame:
    return retrieval.per_query(_ranked(b, low, high), b.s1_val(), b.truth_val(), KS)


def _union(b: Bound) -> DataFrame:
    s1 = b.s1_val()
    two = [signals.candidates(signals.SIGNALS[f"country_{k}"], s1, b.targets) for k in ("norm_name", "norm_addr")]
    return hardneg.union_recall(hardneg.union_candidates(*two), b.truth)


def _by_way_of(spark: SparkSession, write: Callable[[str], object], read: Callable[[str], DataFrame]) -> DataFrame:
    """What `read` finds in the folder that `write` filled, as a stored table; the folder goes."""
    path = [shared.scratch(spark, "files")]
    write(path[0])
    out = shared.stored(read(path[0]), "read")
    shared.discard(spark, path)
    return out


def _write_tsv(b: Bound, path: str, *by: str) -> None:
    rows = b.raw.select(*tables.RECORD.names, *by).write.partitionBy(*by)
    rows.options(sep="\t", header=True, escape='"', quoteAll=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def _tsv(b: Bound, read: Callable[[str], DataFrame], *by: str) -> DataFrame:
    return _by_way_of(b.spark, lambda path: _write_tsv(b, path, *by), read)


def _tsv_sql(b: Bound, path: str) -> DataFrame:
    """SQL over a view of delimited files."""
    tables.read_tsv(b.spark, path).createOrReplaceTempView("records_file")
    return b.spark.sql("SELECT country, count(*) AS n, count_if(business_address = '') AS no_address FROM records_file GROUP BY country")


def _listing(b: Bound, path: str) -> DataFrame:
    folder = F.regexp_extract("path", "source=([^/]*)/[^/]*$", 1)
    return tables.list_files(b.spark, path, "*.csv").groupBy(folder.alias("source")).agg((F.sum("length") > 0).alias("filled"))


#: The columns of the small report of candidates.
STATISTICS = ["split", "key", "total_cand", "avg_cand", "median_cand", "p95_cand", "max_cand", "unresolved_s1", "reduction_ratio"]


def _csv_report(b: Bound) -> DataFrame:
    panel = _rounded(_panel(b, False))
    kinds = panel.select(STATISTICS).schema
    return _by_way_of(b.spark, lambda path: sinks.write_csv(panel, path, STATISTICS), lambda path: sinks.read_csv_report(b.spark, path, kinds))


def _json_report(b: Bound) -> DataFrame:
    rows = hardneg.hard_negatives(b.s1, tables.targets_of(b.records, "S2"), b.truth)
    return _by_way_of(b.spark, lambda path: sinks.write_json(rows, path), lambda path: b.spark.read.schema(rows.schema).json(path))


def _markdown_report(b: Bound) -> DataFrame:
    text = sinks.markdown_table(audit.country_distribution(b.raw).select("source", F.concat("country", F.lit("|")).alias("country"), "n"))
    return b.spark.createDataFrame([(line,) for line in text.splitlines()], "line string")


def _durations(b: Bound) -> DataFrame:
    return b.spark.createDataFrame([(s, sinks.duration(s)) for s in range(0, 9000, 59)], "seconds int, shown string")


def _hindi(b: Bound) -> DataFrame:
    """The records, some targets of which carry a legal form in Devanagari letters."""
    some = (F.col("source") != "S1") & (F.crc32(F.col("entity_id").cast("binary")) % 3 == 0)
    return b.raw.withColumn("business_name", F.when(some, F.concat("business_name", F.lit(" प्राइवेट लिमिटेड"))).otherwise(F.col("business_name")))


def _script_pairs(b: Bound) -> DataFrame:
    records = _hindi(b)
    return audit.script_mismatch(audit.hydrated(b.truth, records, records))


def _checkpoint_resume(b: Bound) -> DataFrame:
    """The ranked candidates by way of a store that stopped after its first block; the targets
    are fitted once for all blocks."""
    used: list[str] = []
    queries = shared.stored(b.s1_val(), "queries", into=used)
    fitted = retrieval.fit(b.targets, 3, 5, into=used)
    path = shared.scratch(b.spark, "store")
    make = lambda: sinks.ResumableStore(b.spark, path, 3, [queries, fitted.words], grams=(3, 5), k=10, min_df=retrieval.MIN_DF, max_df=retrieval.MAX_DF)
    work = lambda q: retrieval.search(q, fitted, 10)

    class Stop(Exception):
        pass

    def stop(block: int) -> None:
        raise Stop

    try:
        make().run(queries, "entity_id", work, stop)
    except Stop:
        pass
    out = shared.stored(make().run(queries, "entity_id", work), "resumed")
    shared.discard(b.spark, [*used, path])
    return out


def _strings(b: Bound, f) -> DataFrame:
    return b.raw.select("entity_id", f(F.col("business_name")).alias("name"), f(F.col("business_address")).alias("address"))


_PLANS: dict[str, Callable[[Bound], DataFrame]] = {
    "norm_basic": lambda b: _strings(b, X.norm_basic),
    "norm_legal": lambda b: b.records.select("entity_id", "norm_name", "norm_name_legal"),
    "norm_audit": lambda b: _strings(b, X.norm_audit),
    "norm_light": lambda b: _strings(b, X.norm_light),
    "gt_pairs_explode": lambda b: b.truth,
    "gt_s1_summary": lambda b: b.summary,
    "split_stratified": lambda b: b.split.select("source1_entity_id", "stratum", "is_val"),
    "targets_union": lambda b: b.targets.select("entity_id", "source", "country", "norm_name", "norm_addr"),
    **{f"signal_{k}": (lambda b, k=k: _candidates(b, k)) for k in signals.SIGNALS},
    **{f"labeled_{k}": (lambda b, k=k: evaluate.label(_candidates(b, k), b.truth)) for k in ("norm_name", "country_legal_norm_name")},
    **{f"per_s1_{k}": (lambda b, k=k: _per_s1(b, k)) for k in ("norm_name", "country_norm_name", "country_legal_norm_name")},
    "per_s1_from_pairs": lambda b: evaluate.per_entity(b.summary, evaluate.counts_of_pairs(evaluate.label(_candidates(b, "country_norm_name"), b.truth))),
    "metrics_panel": lambda b: _panel(b, False),
    "metrics_panel_val": lambda b: _panel(b, True),
    "by_match_class": lambda b: evaluate.breakdown(_per_s1(b, "country_norm_name"), evaluate.match_class(F.col("gt_count")), "match_class"),
    "by_country": lambda b: evaluate.breakdown(_per_s1(b, "country_norm_name"), F.col("country"), "country"),
    "by_target_source": lambda b: evaluate.by_target_source(evaluate.label(_candidates(b, "country_norm_name"), b.truth), b.truth),
    "singleton_panel": lambda b: _per_s1(b, "country_norm_name").agg(
        F.count_if("is_singleton").alias("singletons"), F.count_if(F.col("is_singleton") & (F.col("pred_count") == 0)).alias("correct"),
        F.count_if(F.col("is_singleton") & (F.col("pred_count") > 0)).alias("wrong"),
    ),
    "gt_counts": lambda b: b.split.agg(
        F.sum("match_count").alias("full_pairs"), F.sum(F.when(F.col("is_val"), F.col("match_count"))).alias("val_pairs"), F.count("*").alias("full_s1"), F.count_if("is_val").alias("val_s1"),
    ),
    "union_recall": _union,
    "addr_incompat": lambda b: hardneg.address_conflicts(b.s1_val(), b.targets, b.truth),
    "top_names": lambda b: hardneg.top_names(tables.targets_of(b.raw)),
    "name_literals": lambda b: hardneg.name_dives(b.s1, b.targets, b.truth, b.names()),
    "name_source_counts": lambda b: hardneg.name_counts(b.raw, b.names()),
    "hard_negatives": lambda b: hardneg.hard_negatives(b.s1, tables.targets_of(b.records, "S2"), b.truth),
    "heavy_hitter_filtered_join": lambda b: hardneg.blocked_pairs(signals.SIGNALS["country_norm_name"], b.s1, b.targets, HEAVY),
    "sampled_signals": lambda b: reduce(DataFrame.unionByName, [hardneg.sampled_signal(f, b.s1, b.targets, b.truth, 0.1, HEAVY) for f in SAMPLED]),
    "sql_views": lambda b: views.register(b.records, b.lists).sql(VIEW_SQL),
    "source_stats": lambda b: audit.source_stats(b.raw),
    "country_dist": lambda b: audit.country_distribution(b.raw),
    "length_stats": lambda b: audit.length_stats(b.raw),
    "length_stats_all": lambda b: audit.length_stats(b.raw, filled_only=False),
    "match_count_dist": lambda b: audit.match_counts(b.summary),
    "match_classes": lambda b: audit.match_classes(b.summary),
    "s2_s3_overlap": lambda b: audit.source_overlap(b.truth),
    "multi_assigned": lambda b: audit.multi_assigned(b.truth),
    "exact_rates": lambda b: audit.exact_rates(audit.hydrated(b.truth, b.raw, b.raw)),
    "script_mismatch": lambda b: audit.script_mismatch(audit.hydrated(b.truth, b.raw, b.raw)).agg(F.count("*").alias("n")),
    "missing_asymmetry": lambda b: audit.missing_asymmetry(audit.hydrated(b.truth, b.raw, b.raw)),
    "name_variations": lambda b: audit.variations(audit.hydrated(b.truth, b.raw, b.raw), "business_name"),
    "address_variations": lambda b: audit.variations(audit.hydrated(b.truth, b.raw, b.raw), "business_address"),
    "pair_space": lambda b: audit.brute_force_space(b.raw),
    "char_ngrams": lambda b: retrieval.gram_counts(b.s1, 3, 5),
    "ngram_df": lambda b: retrieval.vocabulary(retrieval.gram_counts(b.targets, 3, 5), b.targets).select("country", "gram", "df", F.round("idf", 6).alias("idf")),
    "tfidf_weights": lambda b: retrieval.weights(c := retrieval.gram_counts(b.targets, 3, 5), retrieval.vocabulary(c, b.targets)).withColumn("weight", F.round("weight", 6)),
    "topk_3_5": lambda b: _ranked(b, 3, 5),
    "topk_3_6": lambda b: _ranked(b, 3, 6),
    "recall_at_k": lambda b: retrieval.recall_panel(_recall(b, 3, 5), "3_5").where("grouping = 'OVERALL'").select("k", "pair_recall"),
    "complete_recovery": lambda b: retrieval.recall_panel(_recall(b, 3, 5), "3_5").select("grouping", "k", "s1_complete_recovery"),
    "recall_panel": lambda b: retrieval.recall_panel(_recall(b, 3, 5), "3_5"),
    "candidate_overlap": lambda b: retrieval.overlap(_ranked(b, 3, 5, 20), _ranked(b, 3, 6, 20)),
    "hash_sample": lambda b: split.hash_sample(b.raw, "entity_id", 0.1).select("entity_id"),
    "recall_panel_v1": lambda b: retrieval.recall_panel(_recall(b, 3, 5), "3_5", strict=True).select("grouping", "k", "pair_recall", "s1_complete_recovery", "precision"),
    "tsv_roundtrip": lambda b: _tsv(b, lambda path: tables.read_tsv(b.spark, path)),
    "tsv_columns": lambda b: _tsv(b, lambda path: tables.read_tsv(b.spark, path, columns=["entity_id", "country"])),
    "tsv_sql": lambda b: _tsv(b, lambda path: _tsv_sql(b, path)),
    "file_listing": lambda b: _tsv(b, lambda path: _listing(b, path), "source"),
    "csv_report": _csv_report,
    "json_report": _json_report,
    "markdown_report": _markdown_report,
    "duration_format": _durations,
    "norm_legal_hindi": lambda b: tables.normalized(_hindi(b)).select("entity_id", "norm_name", "norm_name_legal"),
    "script_examples": lambda b: audit.variations(_script_pairs(b), "business_name", limit=10),
    "script_counts": lambda b: _script_pairs(b).groupBy("s1_country").agg(F.count("*").alias("n")),
    "checkpoint_resume": _checkpoint_resume,
}

#: Columns that are rounded in both engines, since sums of doubles depend on their order.
_ROUNDED = 6


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, _ROUNDED).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, plan=plan: _rounded(plan(Bound(spark, sf_dir)))) for name, plan in _PLANS.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked exact-name matching from raw records to its metric row."""
    b = Bound(spark, sf_dir)
    return _rounded(evaluate.panel(_per_s1(b, "country_norm_name"), b.raw.where("source <> 'S1'").count(), split="full", key="country_norm_name"))


@cache
def oracle() -> dict[str, str]:
    from tessera.plans.oracle import SQL

    return SQL
