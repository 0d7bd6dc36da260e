import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Build a table from rows and a schema, in a few partitions."""

    def build(rows, schema, partitions=3):
        return spark.createDataFrame(rows, schema).repartition(partitions)

    return build
