"""Reading texts and prompts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_texts(spark: SparkSession, path: str, form: str = "parquet", key: str | None = None,
               text: str = "text", schema: str | None = None,
               min_partitions: int | None = None) -> DataFrame:
    """(id, text) from parquet, JSON or plain text; only the two columns are read.

    Scanning is bound by CPU: ``min_partitions`` spreads an input of few, large splits
    over the cores, and does nothing where there are enough splits already.
    """
    reader = spark.read.format(form)
    if schema:
        reader = reader.schema(schema)
    df = reader.load(path)
    if form == "text":
        df = df.select(F.col("value").alias("text"))
    else:
        columns = ([F.col(key).alias("id")] if key else []) + [F.col(text).alias("text")]
        df = df.select(*columns)
    return spread(df, min_partitions)


def spread(df: DataFrame, min_partitions: int | None) -> DataFrame:
    if min_partitions and df.rdd.getNumPartitions() < min_partitions:
        return df.repartition(min_partitions)
    return df
