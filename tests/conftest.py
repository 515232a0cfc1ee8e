import os
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tessera.session import session

    home = tmp_path_factory.mktemp("spark")
    s = session("tests", f"local[{os.environ.get('TEST_CPUS', '4')}]", memory="4g", partitions=8, **{
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.warehouse.dir": str(home / "warehouse"), "spark.checkpoint.dir": f"file://{home}/shared",
    })
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF


def rows_of(columns, rows):
    """Rows as sorted tuples of texts, columns by name, numbers to nine digits."""
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    show = lambda v: "null" if v is None else str(v) if isinstance(v, bool) else f"{float(v):.9g}" if isinstance(v, (int, float)) or hasattr(v, "is_nan") else str(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def same_as_sql(spark, sf_dir):
    """Runs a named query and its SQL on the same tables and compares all rows."""
    db = duckdb.connect()
    for file in Path(sf_dir).iterdir():
        glob = f"{file}/*.parquet" if file.is_dir() else str(file)
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{glob}')")

    def check(query, sql):
        got = query(spark, sf_dir)
        want = db.execute(sql)
        names = [c[0] for c in want.description]
        assert sorted(got.columns) == sorted(names)
        mine, theirs = rows_of(got.columns, got.collect()), rows_of(names, want.fetchall())
        assert mine == theirs

    return check
