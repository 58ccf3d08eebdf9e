"""Every registered region query against its SQL on the smallest tables."""

import pytest
from conftest import DATA, rows

from regionspark.plans import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, f"{DATA}/sf0.001").toPandas()
    want = duck.execute(queries.ORACLE_SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans_push_filters_and_avoid_nested_loops(spark):
    plan = queries.QUERIES["box_self_join"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan
    boxes = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0)], "id string, min_x double, min_y double, max_x double, max_y double")
    import tempfile

    from regionspark.functions.requests import box_intersects

    spark.conf.set("spark.sql.maxMetadataStringLength", 2000)
    path = tempfile.mkdtemp() + "/b"
    boxes.write.parquet(path)
    plan = spark.read.parquet(path).where(box_intersects((0, 0, 2, 2)))._jdf.queryExecution().toString()
    assert "LessThanOrEqual(min_x,2.0)" in plan and "GreaterThanOrEqual(max_y,0.0)" in plan


def test_simplified_coverage_keeps_shared_borders(spark):
    got = queries.QUERIES["simplified_coverage"](spark, f"{DATA}/sf0.001").toPandas()
    assert (got.n >= 3).all() and len(got)
