"""All queries of the library outside the training-data package: name -> (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import folds, search, vectors
from ..sources.tables import read, views
from . import books, catalog, find, rules
from .dialect import Duck, Spark


def _sql(f, spark: SparkSession, sf_dir: str) -> DataFrame:
    text = f(Spark)
    views(spark, sf_dir, text)
    return spark.sql(text)


#: Inputs for which the text rules matter; the tables hold no Arabic.
CASES = ("الإمام الصادق", "مُحَمَّد", "مصطفى", "رحمة", "١٤٠٢", "الگلپايگاني", "أ", "ؤ", "ئ", "ۀ", "é", "  spaced\tout\ntext  ", "a b", "ًٌ", "", "ISBN 964-440-062-3", "﻿علم", "ع‌لم")


def normalize(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    cases = spark.createDataFrame([(-i - 1, t) for i, t in enumerate(CASES)], "doc_id long, text string")
    return docs.unionByName(cases).select("doc_id", F.md5(T.normalize(F.col("text"))).alias("norm_md5"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


NORMALIZE_SQL = (
    "SELECT doc_id, md5(trim(regexp_replace(lower(translate(regexp_replace(nfc_normalize(text), " + _quoted(T.MARKS) + ", '', 'g'), " + _quoted(T.LETTERS_FROM + T.DIGITS_FROM) + ", " + _quoted(T.LETTERS_TO + T.DIGITS_TO) + ")), "
    + _quoted(T.WHITE) + ", ' ', 'g'))) AS norm_md5 FROM (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES " + ", ".join(f"({-i - 1}, {_quoted(t)})" for i, t in enumerate(CASES)) + ") v(a, b)) t"
)


def order_key(spark, sf_dir):
    s = read(spark, sf_dir, "supplier")
    label = F.when(F.col("s_nationkey") % 3 == 0, F.concat(F.lit("ق "), F.col("s_nationkey").cast("string"))).when(F.col("s_nationkey") % 3 == 1, F.col("s_nationkey").cast("string"))
    return s.select("s_suppkey", T.order_key(label, F.when(F.col("s_nationkey") % 3 == 1, F.col("s_nationkey") * 100)).cast("long").alias("k"))


ORDER_KEY_SQL = "SELECT s_suppkey, CAST(CASE WHEN s_nationkey % 3 = 0 THEN s_nationkey * 100 - 50 WHEN s_nationkey % 3 = 1 AND s_nationkey * 100 BETWEEN 1 AND 1500 THEN s_nationkey * 100 ELSE 99999 END AS BIGINT) AS k FROM supplier"

QUERIES = {k: functools.partial(_sql, f) for k, f in catalog.QUERIES.items()}
QUERIES |= {"normalize": normalize, "order_key": order_key}
QUERIES |= {
    "vector_topk": lambda spark, d: vectors.topk(read(spark, d, "embeddings").filter("vec_id % 50 = 0"), read(spark, d, "embeddings"), 5),
    "vector_lsh": lambda spark, d: vectors.lsh_topk(read(spark, d, "embeddings").filter("vec_id % 50 = 0"), read(spark, d, "embeddings"), 5),
    "point_id": lambda spark, d: search.point_ids(read(spark, d, "documents")),
    "chunk_pages": lambda spark, d: search.chunks(read(spark, d, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("book"), F.col("doc_id").alias("sequence"), F.array(F.struct(F.lit("heading").alias("type"), F.substring("text", 1, 20).alias("text")), F.struct(F.lit("text").alias("type"), F.col("text").alias("text")), F.struct(F.lit("footnotes").alias("type"), F.lit("left out").alias("text"))).alias("blocks"))),
    "sync_merge": lambda spark, d: folds.sync_merge(read(spark, d, "events")),
    "rate_fold": lambda spark, d: folds.rate_fold(read(spark, d, "events")),
    "lis_chain": lambda spark, d: folds.lis_chain(read(spark, d, "events").select(F.col("user_id").alias("grp"), F.col("event_id").alias("x"), F.col("value").alias("y"))),
}

SQL = {k: f(Duck) for k, f in catalog.QUERIES.items()} | {"normalize": NORMALIZE_SQL, "order_key": ORDER_KEY_SQL}
SQL["vector_topk"] = """SELECT query, vec_id, score, rank FROM (SELECT q.vec_id AS query, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) DESC, v.vec_id) AS rank FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q JOIN embeddings v ON true) t WHERE rank <= 5"""

QUERIES |= books.QUERIES
SQL |= books.SQL
QUERIES |= find.QUERIES
SQL |= find.SQL
QUERIES |= rules.QUERIES
SQL |= rules.SQL
