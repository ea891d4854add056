import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", tempfile.mkdtemp(prefix="spark-"))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def compare(spark):
    """Run a query and its SQL on the smallest tables and compare rows and columns."""
    import duckdb

    import __spark_entry__

    found, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    con = duckdb.connect()
    for path in Path(SMALL).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")

    def tidy(rows, columns):
        order = sorted(range(len(columns)), key=lambda k: columns[k])
        cell = lambda x: f"{x + 0.0:.5f}" if isinstance(x, float) else repr(x)
        return sorted(tuple(cell(r[k]) for k in order) for r in rows), sorted(columns)

    def run(name):
        df = found[name](spark, SMALL)
        result = con.execute(oracle[name])
        ours, theirs = tidy(df.collect(), df.columns), tidy(result.fetchall(), [d[0] for d in result.description])
        assert ours == theirs, name

    return run
