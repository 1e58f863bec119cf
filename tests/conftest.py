from __future__ import annotations

import os
import sys
import tempfile

import duckdb
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="spark-tests-")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.local.dir", folder)
        .config("spark.checkpoint.dir", f"{folder}/shared").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SMALL}/{name}'")
    return con


def plain(value):
    """Values that both engines give alike: floats to six places, lists as tuples."""
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


@pytest.fixture(scope="session")
def agree(spark, duck):
    def check(query, sql: str) -> None:
        df = query(spark, SMALL)
        columns = sorted(df.columns)
        ours = sorted(str(tuple(map(plain, r))) for r in df.select(*columns).collect())
        found = duck.sql(sql)
        assert sorted(found.columns) == columns
        theirs = sorted(str(tuple(plain(r[found.columns.index(c)]) for c in columns)) for r in found.fetchall())
        assert ours == theirs

    return check
