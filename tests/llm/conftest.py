import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """frame(rows, schema) -> DataFrame."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)
