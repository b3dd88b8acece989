"""Numbers by order, without one task for all rows or for a whole group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(rows: DataFrame, by: str, key: str, name: str = "sequence", stretch: int = 1 << 16) -> DataFrame:
    """rows with their number within `by`, in order of the whole number `key`, from 1.

    Stretches of the key are counted first and their sums run over the stretches of a group, so a group with a third of
    all rows is spread over as many tasks as it has stretches.
    """
    own = rows.withColumn("_part", F.floor(F.coalesce(F.col(key), F.lit(-1)) / stretch))
    before = Window.partitionBy(by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = own.groupBy(by, "_part").agg(F.count("*").alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    sums = sums.select(F.col(by).alias("_by"), F.col("_part").alias("_p"), "_before")
    within = F.row_number().over(Window.partitionBy(by, "_part").orderBy(key))
    out = own.withColumn("_at", within).join(sums, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_p")))
    return out.withColumn(name, (F.col("_before") + F.col("_at")).cast("long")).drop("_part", "_by", "_p", "_before", "_at")


def ranked(rows: DataFrame, order: list[Column], name: str = "position") -> DataFrame:
    """rows with their place in the whole order, from 1: ranges are sorted in tasks of their own, a count of each goes to the driver."""
    laid = rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).persist()
    sizes = {r["p"]: r["n"] for r in laid.groupBy(F.shiftrightunsigned("_at", 33).alias("p")).agg(F.count("*").alias("n")).collect()}
    before, total = [F.lit(-1), F.lit(0)], 0
    for p in sorted(sizes):
        before += [F.lit(p).cast("long"), F.lit(total)]
        total += sizes[p]
    offset = F.create_map(F.lit(-1).cast("long"), F.lit(0), *before[2:])
    return laid.withColumn(name, (F.element_at(offset, F.shiftrightunsigned("_at", 33)) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("long")).drop("_at")


def first_page(rows: DataFrame, order: list[Column], page: int, limit: int, name: str = "position") -> DataFrame:
    """The rows of one page of results, with their places. At most page x limit rows leave the tasks that sort them."""
    top = rows.orderBy(*order).limit(page * limit)
    at = Window.orderBy(*order)
    return top.withColumn(name, F.row_number().over(at).cast("long")).filter(F.col(name) > (page - 1) * limit)


def with_total(rows: DataFrame, of: DataFrame, name: str = "total") -> DataFrame:
    """rows beside the number of rows of `of`, one row of an aggregate."""
    return rows.crossJoin(F.broadcast(of.agg(F.count("*").alias(name))))
