"""Windows over the pages of a book."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def around(value: str, by, reach: int, zeros: bool = False) -> Column:
    """The values of the `reach` rows before and after in order of size, without the row itself and, as a rule, without zeros."""
    near = F.concat(F.collect_list(value).over(by.rowsBetween(-reach, -1)), F.collect_list(value).over(by.rowsBetween(1, reach)))
    return F.sort_array(near if zeros else F.filter(near, lambda x: x != 0))


def neighbour_median(docs: DataFrame, reach: int = 5) -> DataFrame:
    """book, sequence, local: the upper median length of the `reach` pages before and after, without the page itself and without empty ones.

    Null for a page that has no such neighbour.
    """
    lengths = docs.select(F.col("source").alias("book"), "doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("l"))
    pages = Window.partitionBy("book").orderBy("doc_id", "l")
    rows = lengths.select("book", F.row_number().over(pages).cast("long").alias("sequence"), around("l", pages, reach).alias("near"))
    return rows.select("book", "sequence", F.get("near", F.floor(F.size("near") / 2).cast("int")).alias("local"))


def as_of(left: DataFrame, right: DataFrame, by: str, at: str, take: str) -> DataFrame:
    """left with `take` of the latest row of right with the same `by`, up to and with its time; null if there is none.

    Rows of both sides lie on one line for each `by`; nothing is paired.
    """
    a = left.withColumn("_side", F.lit(1)).withColumn("_given", F.lit(None).cast(right.schema[take].dataType)).withColumn("_row", F.struct(*left.columns))
    b = right.select(by, at, F.lit(0).alias("_side"), F.col(take).alias("_given")).withColumn("_row", F.lit(None).cast(a.schema["_row"].dataType))
    line = Window.partitionBy(by).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    both = a.select(by, at, "_side", "_given", "_row").unionByName(b).withColumn("_last", F.last("_given", ignorenulls=True).over(line))
    return both.filter("_side = 1").select("_row.*", F.col("_last").alias(take))


def ranges(starts: DataFrame, last: DataFrame) -> DataFrame:
    """book, start, stop: each range ends before the next one, the last one with its book. starts: book, start; last: book, last."""
    after = F.lead("start").over(Window.partitionBy("book").orderBy("start"))
    return starts.withColumn("_next", after).join(last, "book").select("book", "start", F.coalesce(F.col("_next") - 1, F.col("last")).alias("stop"))


def without_front(pages: DataFrame, upto: int = 12, least: int = 5) -> DataFrame:
    """pages (book, sequence, front) without those that look like front matter among the first `upto`, if `least` are left; else all."""
    drop = F.col("front") & (F.col("sequence") <= upto)
    left = pages.groupBy(F.col("book").alias("_b")).agg(F.count_if(~drop).alias("_left"))
    return pages.join(left, F.col("book") == F.col("_b")).filter(~drop | (F.col("_left") < least)).drop("_b", "_left")
