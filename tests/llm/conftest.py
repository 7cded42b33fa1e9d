import pytest

FIELDS = "doc_id long, text string"


@pytest.fixture(scope="session")
def frame(spark):
    """Small tables by rows and columns."""

    def make(rows, schema=FIELDS):
        return spark.createDataFrame(rows, schema)

    return make
