"""Tables of the input as DataFrames and views."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def views(spark: SparkSession, sf_dir: str, sql: str) -> None:
    """Temporary views of the tables that sql names."""
    for t in TABLES:
        if t in sql:
            read(spark, sf_dir, t).createOrReplaceTempView(t)
