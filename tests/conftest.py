import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    conf = {"spark.sql.shuffle.partitions": "4", "spark.default.parallelism": "4", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": str(tmp_path_factory.mktemp("shared"))}
    session = SparkSession.builder.master("local[4]").config(map=conf).getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def data():
    return "/root/testdata/sf0.001"


def plain(value):
    """A value of either engine in one form; numbers to nine digits."""
    if hasattr(value, "tolist"):
        value = value.tolist()
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    return repr(round(value, 9) + 0.0) if isinstance(value, float) else str(value)


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Asserts that a query gives the rows of its SQL, and some, at a scale at which none is empty."""
    import duckdb

    data = "/root/testdata/sf0.01"

    con = duckdb.connect()
    for path in Path(data).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")

    def check(query, sql: str) -> None:
        got = query(spark, data)
        names = sorted(got.columns)
        want = con.execute(sql)
        order = [[d[0] for d in want.description].index(n) for n in names]
        rows = sorted(tuple(plain(r[i]) for i in order) for r in want.fetchall())
        assert sorted(tuple(plain(r[n]) for n in names) for r in got.collect()) == rows
        assert rows

    return check
