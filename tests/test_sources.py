"""Readers, writers and the resumable store."""

import pytest
from pyspark.sql import functions as F

from tessera.sources import sinks, tables


def test_tsv(spark, tmp_path):
    file = tmp_path / "a.tsv"
    file.write_text('entity_id\tbusiness_name\tbusiness_address\tcountry\nS1-1\tNA\t\tnull\nS1-2\t"He said ""hi"""\t"two\nlines"\tUS\n')
    rows = sorted(map(tuple, tables.read_tsv(spark, str(file)).collect()))
    assert rows == [("S1-1", "NA", "", "null"), ("S1-2", 'He said "hi"', "two\nlines", "US")]
    assert tables.read_tsv(spark, str(file), columns=["country"]).columns == ["country"]
    assert tables.list_files(spark, str(tmp_path), "*.tsv").count() == 1


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 0.5), ("c", None)], "x string, y double")
    sinks.write_parquet(df, str(tmp_path / "p"))
    assert tables.read_parquet(spark, str(tmp_path / "p"), ["x"]).count() == 2
    sinks.write_csv(df, str(tmp_path / "c"), ["x"])
    assert sinks.read_csv_report(spark, str(tmp_path / "c"), "x string").count() == 2
    sinks.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert sinks.markdown_table(df.orderBy("x")) == "| x | y |\n| --- | --- |\n| a/b | 0.5000 |\n| c |  |\n"
    assert [sinks.duration(s) for s in (5.25, 65, 3700)] == ["5.2s", "1m 5s", "1h 1m"]


def test_resume(spark, tmp_path):
    """A run that stops after a block goes on with the others; other parameters start anew."""
    queries = spark.range(100).withColumn("id", F.col("id").cast("string"))
    seen = []

    def work(df):
        seen.append(1)
        return df.select("id", F.lit(1).alias("one"))

    def stop(block):
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        sinks.ResumableStore(spark, str(tmp_path), 4, k=10).run(queries, "id", work, stop)
    out = sinks.ResumableStore(spark, str(tmp_path), 4, k=10).run(queries, "id", work)
    assert len(seen) == 4 and out.count() == 100 and out.select("id").distinct().count() == 100
    sinks.ResumableStore(spark, str(tmp_path), 4, k=20).run(queries, "id", work)
    assert len(seen) == 8


def test_store_of_other_rows_and_damaged_blocks(spark, tmp_path):
    """Blocks of other inputs are not served; a damaged or short block is written again."""
    queries = spark.range(60).withColumn("id", F.col("id").cast("string"))
    seen = []

    def run(factor):
        values = queries.withColumn("value", F.length("id") * factor)

        def work(df):
            seen.append(1)
            return df.select("id", "value")

        return {r["id"]: r["value"] for r in sinks.ResumableStore(spark, str(tmp_path), 3, [values]).run(values, "id", work).collect()}

    assert run(1)["10"] == 2 and run(2)["10"] == 4 and len(seen) == 6
    assert run(1)["10"] == 2 and len(seen) == 6
    folders = sorted(tmp_path.glob("*/data/block=1"))
    for damaged, folder in enumerate(folders):
        for part in folder.glob("part-*.parquet"):
            part.unlink() if damaged else part.write_bytes(b"PAR1 no more")
        for crc in folder.glob(".part-*.crc"):
            crc.unlink()
    assert run(1)["10"] == 2 and run(2)["10"] == 4 and len(seen) == 8 and len(run(2)) == 60


def test_long_reports_are_whole(spark):
    assert sinks.markdown_table(spark.range(250)).count("\n") == 252


def test_shared_folder(spark):
    from tessera.sources import shared

    before = spark.conf.get(shared._BATCH_ROWS)
    with shared.batches_of(spark, 7):
        with shared.batches_of(spark, 9):
            assert spark.conf.get(shared._BATCH_ROWS) == "7"
        assert spark.conf.get(shared._BATCH_ROWS) == "7"
    assert spark.conf.get(shared._BATCH_ROWS) == before

    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared.scratch(Cluster, "x")


def test_session_settings(spark):
    from tessera.session import session

    assert session().conf.get("spark.sql.session.timeZone") == "UTC" and session(partitions=8).conf.get("spark.sql.shuffle.partitions") == "8"


def test_heavy_keys(spark):
    from tessera.operators.signals import without_heavy_keys

    left = spark.createDataFrame([("a",), ("b",)], "k string")
    right = spark.createDataFrame([("a",)] * 3 + [("b",)], "k string")
    a, b = without_heavy_keys(left, right, "k", 2)
    assert [r["k"] for r in a.collect()] == ["b"] and [r["k"] for r in b.collect()] == ["b"]


def test_report(spark, sf_dir, tmp_path):
    from tessera.plans import report

    text = report.markdown(spark, sf_dir, {"Sources": ["source_stats"], "Ground truth": ["match_classes"]})
    assert "## Sources" in text and "| source | total_rows |" in text and "matches_4_plus" in text
    report.write(spark, sf_dir, str(tmp_path))
    assert spark.read.option("header", True).csv(f"{tmp_path}/metrics").count() == 12
    assert spark.read.text(f"{tmp_path}/audit").where("value like '# Audit%'").count() == 1
    assert spark.read.json(f"{tmp_path}/hard_negatives").count() <= 20
