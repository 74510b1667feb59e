"""Texts that an operator keeps go to Python once."""

import pyarrow as pa
from pyspark.sql import types as T

from veilframe.llm.common import map_texts


def test_kept_text_is_sent_once(spark):
    """The pipeline's stages keep all columns; the text went out twice beside them."""
    def make():
        return lambda texts: [pa.array([len(t or "") for t in texts], pa.int64())]

    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    made = map_texts(docs, ("doc_id", "text"), "text", [T.StructField("n", T.LongType())], make)
    plan = made._jdf.queryExecution().analyzed().toString()
    assert " AS t#" not in plan
    assert sorted(map(tuple, made.collect())) == [(1, "ab", 2), (2, None, 0)]
