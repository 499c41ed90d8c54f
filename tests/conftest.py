import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in Path("/root/testdata/sf0.01").glob("*.parquet"):
        c.sql(f"create view {f.stem} as select * from '{f}'")
    return c


@pytest.fixture(scope="session")
def same(spark, duck):
    """Holds a query at sf0.01 against its SQL: columns, rows and values, in any order."""

    def check(query, sql):
        got, want = query(spark, "/root/testdata/sf0.01").toPandas(), duck.sql(sql).df()
        columns = sorted(got.columns)
        assert columns == sorted(want.columns)
        rows = [sorted(map(repr, x[columns].astype(object).where(x[columns].notna(), None).itertuples(index=False, name=None))) for x in (got, want)]
        assert rows[0] == rows[1]
        return len(got)

    return check
