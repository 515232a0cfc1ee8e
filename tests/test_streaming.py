"""Incremental ingestion takes each file once."""

from tessera.streaming.ingest import ingest, record_stream

HEAD = "entity_id\tbusiness_name\tbusiness_address\tcountry\n"


def test_ingest(spark, tmp_path):
    folder, out, state = (tmp_path / n for n in ("in", "out", "state"))
    folder.mkdir()

    def run():
        ingest(record_stream(spark, str(folder), "S2"), str(out), str(state)).awaitTermination()
        return sorted((r["entity_id"], r["norm_name_legal"], r["country"]) for r in spark.read.parquet(str(out)).collect())

    (folder / "a.tsv").write_text(HEAD + "S2-1\tAcme Pvt. Ltd.\t\tUS\n")
    assert run() == [("S2-1", "acme", "US")]
    (folder / "b.tsv").write_text(HEAD + "S2-2\tÉtoile SA\tx\tFrance\n")
    assert run() == [("S2-1", "acme", "US"), ("S2-2", "etoile", "France")]
    assert len(run()) == 2
