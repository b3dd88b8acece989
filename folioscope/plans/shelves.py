"""Works, books, authors and pages of a library on the input's tables, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import read


def books_of(spark, sf_dir) -> DataFrame:
    """book_id, work_id, author_id, volume, bytes, published, language."""
    line = read(spark, sf_dir, "lineitem")
    key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"), F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"), F.col("l_shipdate").cast("date").cast("string"))
    return line.select(key.alias("book_id"), F.col("l_partkey").alias("work_id"), F.col("l_suppkey").alias("author_id"), F.col("l_linenumber").alias("volume"), (F.col("l_quantity") * 100).cast("long").alias("bytes"), (F.col("l_returnflag") != "R").alias("published"), F.col("l_linestatus").alias("language"))


def works_of(spark, sf_dir) -> DataFrame:
    """work_id, title, subject, library, featured, featured_order."""
    p = read(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("work_id"), F.col("p_name").alias("title"), F.col("p_brand").alias("subject"), F.col("p_type").alias("library"), (F.col("p_size") <= 5).alias("featured"), F.col("p_size").alias("featured_order"))


def authors_of(spark, sf_dir) -> DataFrame:
    """author_id, name, death_label."""
    s = read(spark, sf_dir, "supplier")
    k = F.col("s_nationkey")
    label = F.when(k % 3 == 1, F.concat(F.lit("ق "), k.cast("string"))).when(k % 3 == 2, (300 + k).cast("string"))
    return s.select(F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("name"), label.alias("death_label"))
