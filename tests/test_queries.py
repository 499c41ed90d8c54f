import pytest

from lamina import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(same, name):
    assert same(queries.QUERIES[name], queries.ORACLE_SQL[name]) > 0


def test_entry_module(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_every_query_has_sql():
    assert set(queries.QUERIES) == set(queries.ORACLE_SQL)


def test_key_filter_is_pushed_to_the_scan(spark, tmp_path):
    """A filter on the key passes below the reduction; one on the value must not."""
    from pyspark.sql import functions as F

    from lamina.operators.resolve import newest
    from lamina.schema import MUTATION

    path = str(tmp_path / "plan")
    spark.createDataFrame([("a", "1", 1, 1, False), ("a", "2", 2, 2, True)], MUTATION).write.mode("overwrite").parquet(path)
    rows = newest(spark.read.parquet(path))
    assert "EqualTo(key,a)" in rows.where("key = 'a'")._jdf.queryExecution().toString()
    assert rows.where(F.col("value") == "1").count() == 0


def test_no_operator_imports_the_training_package():
    from pathlib import Path

    root = Path(queries.__file__).parent
    for f in root.rglob("*.py"):
        if "llm" not in f.relative_to(root).parts:
            assert "lamina.llm" not in f.read_text()
