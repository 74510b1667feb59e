import pytest


@pytest.fixture
def frame(spark):
    def make(rows, schema="doc_id long, text string", parts=3):
        return spark.createDataFrame(rows, schema).repartition(parts)

    return make
