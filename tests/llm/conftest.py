import pytest


@pytest.fixture()
def frame(spark):
    return lambda rows, schema: spark.createDataFrame(list(rows), schema)
