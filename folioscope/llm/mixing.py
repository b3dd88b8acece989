"""Mixing sources to target weights by systematic sampling.

Within a source every document has the same expected number of copies, target / size of the source. Documents are laid
in one order: by size class (so that each stretch of the line has its share of long and short texts), then by a cell,
then by id. The running sum of expected copies starts at one random offset for each source, and a document is emitted
once for each integer that the sum crosses.

The running sum has two levels: cells (source, size class, spread of the id) are counted and summed first, at most
CLASSES x SPREAD rows for each source; the order within a cell is a window of its own. A source with a third of all
rows is thus split over thousands of cells.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a null id comes first;
repeated rows are rows of their own; sources without words get the target 0; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, boxed, cut

WEIGHTS = (3, 1, 2)
SPREAD = 64
SEED = 7
#: The golden ratio's fraction, as thousandths of thousandths: offsets of consecutive sources are far apart.
STEP = 618034


def cell_of(size: Column, doc_id: Column) -> tuple[Column, Column]:
    return F.floor(F.log2(size + 1) * 8).cast("long"), F.pmod(F.coalesce(doc_id, F.lit(-1)), F.lit(1 << 31)).cast("long") * 40503 % 65536 % SPREAD


def targets(sizes: DataFrame, percent: int = 150, cap: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, size, docs) -> with target: percent of all sizes, shared by weight, at most cap times a source's size.

    Sources at their cap are those with the least size for their weight; the level of the others follows from running
    sums over the sources in that order, so no rounds of resharing are needed. The table has one row for each source.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    t = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumn("w", w)
    t = t.withColumn("cap", cap * F.col("source_size"))
    by = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    upto = by.rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = t.withColumn("left", F.sum("source_size").over(all_) * percent - 100 * F.coalesce(F.sum("cap").over(upto), F.lit(0)))
    t = t.withColumn("left_w", F.sum("w").over(all_) - F.coalesce(F.sum("w").over(upto), F.lit(0)))
    # the first source that stays under its cap, with all before it at theirs
    free = F.col("left") * F.col("w") <= 100 * F.col("cap") * F.col("left_w")
    t = t.withColumn("free", F.when(free, F.struct((F.col("cap") / F.col("w")).alias("r"), "rank", "left", "left_w")))
    t = t.withColumn("free", F.min("free").over(all_))
    below = F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("rank")) < F.struct(F.col("free.r"), F.col("free.rank"))
    share = (F.col("free.left") * F.col("w")).cast("double") / (100 * F.col("free.left_w"))
    return t.select("source", "source_size", "docs", "rank", F.when(F.col("free").isNull() | below, F.col("cap").cast("double")).otherwise(share).alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", keep: tuple[str, ...] = (), seed: int = SEED) -> DataFrame:
    """One row for each document: doc_id, source, size, source_size, target, copies, and the columns in keep. seed moves the offsets."""
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), *[F.col(k) for k in keep])
    cls, sub = cell_of(F.col("size"), F.col("doc_id"))
    sized = cut(sized.withColumn("cls", cls).withColumn("sub", sub))
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs")))
    before = Window.partitionBy("source").orderBy("cls", "sub").rowsBetween(Window.unboundedPreceding, -1)
    cells = sized.groupBy("source", "cls", "sub").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    info = cells.alias("c").join(goal.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))).select(F.col("c.source").alias("s2"), F.col("cls").alias("cls2"), F.col("sub").alias("sub2"), "before", "source_size", "target", "rank")
    own = sized.withColumn("at", F.row_number().over(Window.partitionBy("source", "cls", "sub").orderBy("doc_id", "size", *keep)))
    rows = own.join(info, F.col("source").eqNullSafe(F.col("s2")) & (F.col("cls") == F.col("cls2")) & (F.col("sub") == F.col("sub2")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    offset = (F.col("rank") + seed) * STEP % 1000000 / F.lit(1000000.0)
    upto = lambda n: F.floor(n * rate + offset)
    n = F.col("before") + F.col("at")
    return rows.select("doc_id", "source", "size", "source_size", "target", (upto(n) - upto(n - 1)).cast("long").alias("copies"), *keep)


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED) -> DataFrame:
    """docs itself, each row as often as the mix takes it. Rows with the same id, source and text are told apart by number."""
    tag = F.xxhash64(text)
    sized = docs.select(F.col(id_col).alias("id"), F.col(source).alias("source"), F.col(text).alias("text"), tag.alias("tag"))
    taken = mix(sized, "id", "text", "source", ("tag",), seed)
    # equal rows are interchangeable, so their copies are summed and dealt out by number
    total = taken.groupBy("doc_id", "source", "tag").agg(F.sum("copies").alias("copies"), F.count("*").alias("n")).filter("copies > 0")
    total = total.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("tag").alias("t"), "copies", "n")
    own = boxed(docs, id=F.col(id_col), source=F.col(source), tag=tag)
    out = own.join(total, F.col("id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("tag") == F.col("t")))
    nth = F.row_number().over(Window.partitionBy("d", "s", "t").orderBy(F.lit(0)))
    single = out.filter("n = 1").select("row", F.col("copies").alias("times"))
    share = F.floor(F.col("copies") / F.col("n")) + F.when(F.col("i") <= F.col("copies") % F.col("n"), 1).otherwise(0)
    several = out.filter("n > 1").withColumn("i", nth).select("row", share.alias("times"))
    rows = single.unionByName(several).filter("times > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))).select("row.*")


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
c AS (SELECT *, floor(log2(size + 1) * 8)::BIGINT AS cls, coalesce(doc_id, 2147483647) % 2147483648 * 40503 % 65536 % 64 AS sub FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM c GROUP BY source),
w AS (SELECT *, [3, 1, 2][(rank % 3 + 1)::INT] AS w, 2 * source_size AS cap FROM s),
a AS (SELECT *, sum(source_size) OVER () * 150 - 100 * coalesce(sum(cap) OVER b, 0) AS l, sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS lw
      FROM w WINDOW b AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT cap / w AS r, rank, l, lw FROM a WHERE l * w <= 100 * cap * lw ORDER BY 1, 2 LIMIT 1),
g AS (SELECT a.source, a.source_size, a.rank, CASE WHEN f.r IS NULL OR a.cap / a.w < f.r OR (a.cap / a.w = f.r AND a.rank < f.rank) THEN a.cap::DOUBLE
        ELSE (f.l * a.w)::DOUBLE / (100 * f.lw)::DOUBLE END AS target FROM a LEFT JOIN f ON true),
n AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY cls, sub, doc_id, size) AS n FROM c),
t AS (SELECT doc_id, size, source_size, target, n, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate, (rank + 7) * 618034 % 1000000 / 1000000.0::DOUBLE AS o
      FROM n JOIN g ON n.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target, ((floor(n * rate + o) - floor((n - 1) * rate + o)) * size)::BIGINT AS taken FROM t
"""
