import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """A table (doc_id, text) of the given rows over three partitions."""
    return lambda rows: spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
