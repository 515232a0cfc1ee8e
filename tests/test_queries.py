"""Every named query against its DuckDB SQL, and the driver's contract."""

import pytest

import __spark_entry__ as entry
from tessera.plans import queries as plans


@pytest.mark.parametrize("name", sorted(plans.oracle()))
def test_equals_sql(name, same_as_sql):
    same_as_sql(plans.queries()[name], plans.oracle()[name])


def test_every_query_has_sql():
    assert set(plans.queries()) == set(plans.oracle())




def test_contract(spark):
    flagship = entry.entry(spark)
    assert flagship.count() == 1
    assert set(plans.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_counts_without_pairs_equal_counts_of_pairs(spark, sf_dir):
    from tessera.operators import evaluate, signals

    b = plans.Bound(spark, sf_dir)
    every = evaluate.counts_of_signals(list(signals.SIGNALS.values()), b.s1, b.targets, b.truth)
    for key, signal in signals.SIGNALS.items():
        pairs = evaluate.counts_of_pairs(evaluate.label(signals.candidates(signal, b.s1, b.targets), b.truth))
        want = sorted(map(tuple, pairs.select("s1_id", *evaluate.COUNTS).collect()))
        assert sorted(map(tuple, evaluate.counts_of_signal(signal, b.s1, b.targets, b.truth).collect())) == want
        assert sorted(map(tuple, every.where(every.signal == key).drop("signal").collect())) == want


def test_null_and_empty_countries_match_as_joins_do(spark):
    """A null country matches nothing, an empty one an empty one."""
    from tessera.operators import evaluate, signals
    from tessera.sources import tables

    rows = [(f"{s}-{i}", s, "acme", "one street", c, "acme", "acme", "one street") for s in ("S1", "S2", "S3") for i, c in enumerate((None, "", "US", None))]
    rows += [("S2-9", "S2", None, "one street", "US", None, None, "one street"), ("S1-9", "S1", "", "", "US", "", "", "")]
    records = spark.createDataFrame(rows, "entity_id string, source string, business_name string, business_address string, country string, norm_name string, norm_name_legal string, norm_addr string")
    truth = spark.createDataFrame([("S1-0", "S2-0", "S2"), ("S1-1", "S3-1", "S3"), ("S1-2", "S2-2", "S2"), ("S1-2", "S2-9", "S2")], "source1_entity_id string, target_entity_id string, target_source string")
    s1, targets = tables.targets_of(records, "S1"), tables.targets_of(records)
    every = evaluate.counts_of_signals(list(signals.SIGNALS.values()), s1, targets, truth).cache()
    for key, signal in signals.SIGNALS.items():
        pairs = evaluate.counts_of_pairs(evaluate.label(signals.candidates(signal, s1, targets), truth))
        want = sorted(map(tuple, pairs.select("s1_id", *evaluate.COUNTS).collect()))
        assert sorted(map(tuple, evaluate.counts_of_signal(signal, s1, targets, truth).collect())) == want
        assert sorted(map(tuple, every.where(every.signal == key).drop("signal").collect())) == want
        assert not signal.blocked or not {"S1-0", "S1-3"} & {r[0] for r in want}


def test_sampled_signals_of_blank_addresses_equal_sql(spark, tmp_path):
    """Texts of up to 40 characters have no address, and two blanks are no match."""
    import duckdb

    texts = ["a short name", "another short name", "a name of more than forty characters and an address"]
    rows = [(i, texts[i // 3 % 3], "en") for i in range(400)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = db.execute(plans.oracle()["sampled_signals"]).fetchall()
    assert sorted(map(tuple, plans.queries()["sampled_signals"](spark, str(tmp_path)).collect())) == sorted(want)


def test_sampled_signal_counts_heavy_keys_by_the_first_field(spark):
    """Targets without an address count towards a heavy name, though they match nothing."""
    from tessera.operators import hardneg

    kind = "entity_id string, country string, norm_name string, norm_addr string"
    s1 = spark.createDataFrame([("S1-1", "en", "a", "x"), ("S1-2", "en", "a", ""), ("S1-3", "en", "b", "")], kind)
    targets = spark.createDataFrame([("S2-1", "en", "a", "x"), ("S2-2", "en", "a", ""), ("S2-3", "en", "b", ""), ("S2-4", "en", "b", None)], kind)
    truth = spark.createDataFrame([("S1-1", "S2-1"), ("S1-2", "S2-2")], "source1_entity_id string, target_entity_id string")
    found = lambda heavy: hardneg.sampled_signal(("norm_name", "norm_addr"), s1, targets, truth, 0.999999, heavy).first()
    assert tuple(found(2))[1:7] == (1, 1, 0, 1, 1.0, 0.5)
    assert tuple(found(1))[1:7] == (0, 0, 0, 2, 0.0, 0.0)


def test_split_of_a_hot_stratum_and_null_ids(spark):
    from tessera.operators.split import stratified_split

    rows = [(f"S1-{i}", "US", 0) for i in range(1000)] + [(f"S1-x{i}", None, 2) for i in range(10)] + [(None, "US", 1)] * 5
    out = stratified_split(spark.createDataFrame(rows, "source1_entity_id string, country string, match_count int")).collect()
    chosen = lambda stratum: [r["is_val"] for r in out if r["stratum"] == stratum]
    assert len(out) == 1015 and [(len(chosen(s)), sum(chosen(s))) for s in ("US_0", "multi", "US_1")] == [(1000, 200), (10, 2), (5, 1)]


def test_blocks_of_targets_do_not_change_the_ranks(spark, sf_dir, monkeypatch):
    from tessera.operators import retrieval

    b = plans.Bound(spark, sf_dir)
    want = sorted(map(tuple, retrieval.top_k(b.s1, b.targets, 3, 5, 7).collect()))
    for name, value in (("BLOCK_TARGETS", 5), ("_MOST_ROWS", 300), ("CELLS", 20)):
        monkeypatch.setattr(retrieval, name, value)
    assert sorted(map(tuple, retrieval.top_k(b.s1, b.targets, 3, 5, 7).collect())) == want and len(want) > 100


def test_invariants(spark, sf_dir):
    q = plans.queries()
    panel = {r["key"]: r for r in q["metrics_panel"](spark, sf_dir).collect()}
    for key, r in panel.items():
        assert r["total_tp"] + r["total_fp"] == r["total_cand"]
        if f"country_{key}" in panel:
            assert panel[f"country_{key}"]["total_cand"] <= r["total_cand"]
    recall = sorted((r["grouping"], r["k"], r["pair_recall"]) for r in q["recall_panel"](spark, sf_dir).collect())
    for a, b in zip(recall, recall[1:]):
        assert a[0] != b[0] or a[2] <= b[2]
    ranks: dict = {}
    for r in q["topk_3_5"](spark, sf_dir).collect():
        ranks.setdefault(r["source1_entity_id"], []).append(r["rank"])
    assert all(sorted(v) == list(range(1, len(v) + 1)) and len(v) <= 50 for v in ranks.values())
    split = q["split_stratified"](spark, sf_dir).groupBy("stratum").agg({"*": "count"}).collect()
    chosen = {r["stratum"]: r["n"] for r in q["split_stratified"](spark, sf_dir).where("is_val").groupBy("stratum").count().withColumnRenamed("count", "n").collect()}
    for r in split:
        n = r["count(1)"]
        assert chosen.get(r["stratum"], 0) == int(0.2 * n + 0.5)
