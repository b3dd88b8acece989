"""Books as JSON documents: schema, reader, pages in reading order, and a validator. All JVM-side but for one Unicode check."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

#: metadata is a map of strings, as some keys hold a string in one book and a list in another.
BOOK = (
    "schemaVersion int, bookId string, title string, author string, metadata map<string,string>, "
    "pages array<struct<id:string,sequence:int,isBlank:boolean,printedPage:int,sourcePageLabel:string,pageType:string,pageNumber:string,"
    "blocks:array<struct<id:string,type:string,`order`:int,text:string,tocId:string>>>>, "
    "toc array<struct<id:string,`order`:int,title:string,pageId:string,pageNumber:string>>"
)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """One row for each file; a file that is no JSON gives nulls and its text in corrupt."""
    return spark.read.schema(BOOK + ", corrupt string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "corrupt").json(path)


def ordered(items: Column, by: str) -> Column:
    keyed = F.transform(F.coalesce(items, F.array()), lambda x: F.struct(F.coalesce(x[by], F.lit(0)).alias("k"), x.alias("x")))
    return F.transform(F.array_sort(keyed), lambda y: y["x"])


def page_rows(books: DataFrame) -> DataFrame:
    """book_id, sequence, page_number, page_type, is_blank, text, block_offsets (code points), section_ord.

    Blocks are joined with line ends; blocks before the first that holds text add none. section_ord is the number of
    table-of-contents entries up to the page, null before the first; entries of missing pages do not count.
    """
    pages = books.select(F.col("bookId").alias("book_id"), F.explode("pages").alias("p")).select("book_id", "p.*")
    toc = books.select(F.col("bookId").alias("book_id"), F.explode("toc").alias("e")).select("book_id", F.col("e.pageId").alias("id"))
    starts = toc.join(pages.select("book_id", "id", "sequence"), ["book_id", "id"]).groupBy("book_id").agg(F.collect_list("sequence").alias("starts"))
    texts = pages.select("*", F.transform(ordered(F.col("blocks"), "order"), lambda b: F.coalesce(b["text"], F.lit(""))).alias("texts"))
    first = F.array_position(F.transform("texts", lambda t: t != ""), True).cast("int")
    text = F.when(first == 0, "").otherwise(F.array_join(F.slice("texts", F.greatest(first, F.lit(1)), F.size("texts")), "\n"))
    zero = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("at"))

    def add(acc: Column, t: Column) -> Column:
        start = F.when(acc["n"] > 0, acc["n"] + 1).otherwise(0)
        return F.struct((start + F.length(t)).alias("n"), F.concat(acc["at"], F.array(start)).alias("at"))

    offsets = F.aggregate("texts", zero, add)["at"]
    n = F.size(F.filter(F.coalesce("starts", F.array().cast("array<int>")), lambda s: s <= F.col("sequence")))
    rows = texts.join(starts, "book_id", "left")
    return rows.select("book_id", "sequence", F.col("pageNumber").alias("page_number"), F.col("pageType").alias("page_type"), F.coalesce("isBlank", F.lit(False)).alias("is_blank"), text.alias("text"), offsets.alias("block_offsets"), F.when(n > 0, n).alias("section_ord"))


@F.pandas_udf(IntegerType())
def not_composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda ts: 0 if ts is None else sum(not unicodedata.is_normalized("NFC", t) for t in ts))


def issues(books: DataFrame) -> DataFrame:
    """book_id, severity, code, n: how often each rule is broken, for rules that are. A book without pages gets no other finding about its content."""
    pg = ordered(F.col("pages"), "sequence")
    b = books.select("*", pg.alias("pg"), ordered(F.col("toc"), "order").alias("tc"))
    blocks = F.flatten(F.transform("pg", lambda p: F.transform(ordered(p["blocks"], "order"), lambda x, j: F.struct(p["id"].alias("page"), (j + 1).alias("at"), x.alias("b")))))
    number = F.transform(F.filter("pg", lambda p: (p["pageType"] == "main") & p["pageNumber"].rlike("^[0-9]+$")), lambda p: p["pageNumber"].cast("long"))
    front = F.filter("pg", lambda p: (p["pageType"] == "frontMatter") & (F.coalesce(p["pageNumber"], F.lit("")) != ""))
    heads = F.array_distinct(F.transform(F.filter("bl", lambda x: (x["b"]["type"] == "heading") & x["b"]["tocId"].isNotNull()), lambda x: x["b"]["tocId"]))
    b = b.select("*", blocks.alias("bl"), number.alias("nums"), front.alias("front"), F.transform("pg", lambda p: p["id"]).alias("page_ids"), F.transform("tc", lambda e: e["id"]).alias("toc_ids"))
    b = b.select("*", heads.alias("heads"), F.transform("bl", lambda x: x["b"]["id"]).alias("block_ids"), F.transform("bl", lambda x: F.coalesce(x["b"]["text"], F.lit(""))).alias("texts"))
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    count = lambda a, f: F.size(F.filter(a, f))
    repeats = lambda a: F.size(a) - F.size(F.array_distinct(a))
    one = lambda c: F.when(c, 1).otherwise(0)
    has = F.size("pg") > 0
    rules = [
        ("error", "schema_version", one(~F.col("schemaVersion").eqNullSafe(2)), False),
        ("error", "missing_book_id", one(blank("bookId")), False),
        ("error", "missing_title", one(blank("title")), False),
        ("warning", "missing_author", one(blank("author")), False),
        ("error", "no_pages", one(~has), False),
        ("error", "page_sequence_gap", count("pg", lambda p, i: ~p["sequence"].eqNullSafe(i + 1)), True),
        ("error", "page_id_mismatch", count("pg", lambda p, i: ~p["id"].eqNullSafe(F.format_string("p-%06d", i + 1))), True),
        ("error", "duplicate_page_id", repeats("page_ids"), True),
        ("error", "bad_page_type", count("pg", lambda p: ~F.coalesce(p["pageType"], F.lit("")).isin("frontMatter", "main")), True),
        ("error", "bad_page_number", count("pg", lambda p: F.coalesce(p["pageNumber"], F.lit("")) == ""), True),
        ("error", "front_matter_numbering", count("front", lambda p, i: p["pageNumber"] != F.concat(F.lit("0."), (i + 1).cast("string"))), True),
        ("error", "block_order_gap", count("bl", lambda x: ~x["b"]["order"].eqNullSafe(x["at"])), True),
        ("error", "block_id_mismatch", count("bl", lambda x: ~x["b"]["id"].eqNullSafe(F.format_string("%s-b-%03d", x["page"], x["at"]))), True),
        ("error", "duplicate_block_id", repeats("block_ids"), True),
        ("error", "bad_block_type", count("bl", lambda x: ~F.coalesce(x["b"]["type"], F.lit("")).isin("text", "heading", "footnotes")), True),
        ("error", "heading_missing_toc_id", count("bl", lambda x: (x["b"]["type"] == "heading") & x["b"]["tocId"].isNull()), True),
        ("error", "toc_order_gap", count("tc", lambda e, i: ~e["order"].eqNullSafe(i + 1)), True),
        ("error", "duplicate_toc_id", repeats("toc_ids"), True),
        ("error", "toc_dangling_page_ref", F.size(F.array_except(F.transform("tc", lambda e: e["pageId"]), "page_ids")), True),
        ("error", "toc_heading_mismatch", F.size(F.array_except("heads", "toc_ids")) + F.size(F.array_except("toc_ids", "heads")), True),
        ("error", "no_content", one(F.size("bl") == 0), True),
        ("warning", "empty_blocks", count("texts", lambda t: F.trim(t) == ""), True),
        ("warning", "non_nfc_text", not_composed("texts"), True),
        ("warning", "non_monotonic_pages", count(F.zip_with("nums", F.slice("nums", F.lit(2), F.greatest(F.size("nums"), F.lit(1))), lambda x, y: y < x), lambda x: x), True),
    ]
    found = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(c).alias("code"), F.when(has | F.lit(not inner), n).otherwise(0).cast("long").alias("n")) for s, c, n, inner in rules])
    return b.select(F.col("bookId").alias("book_id"), F.inline(F.filter(found, lambda x: x["n"] > 0)))
