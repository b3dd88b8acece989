"""Postings of pages: every term with its places. All work stays within a page's row, so nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import index_line


def _let(value: Column, body) -> Column:
    """body(value), with value computed once for each row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _runs(pairs: Column, gather) -> Column:
    """(term, positions) for pairs (term, at), in order of the terms; gather makes positions from the sorted ats of a term."""

    def run(q: Column) -> Column:
        terms, ats = q["terms"], q["ats"]
        starts = F.filter(F.transform(terms, lambda t, i: F.when((i == 0) | (t != F.get(terms, i - 1)), i)), lambda x: x.isNotNull())
        whole = lambda s: F.transform(s, lambda x, k: F.struct(F.get(terms, x).alias("term"), gather(F.slice(ats, x + 1, F.coalesce(F.get(s, k + 1), F.size(terms)) - x)).alias("positions")))
        return _let(starts, whole)

    return _let(F.sort_array(pairs), lambda p: _let(F.struct(p["term"].alias("terms"), p["at"].alias("ats")), run))


def page_index(docs: DataFrame) -> DataFrame:
    """(doc_id, postings): for each page its terms, folded words, with their positions from 0. A null text has none."""
    words = F.filter(F.split(F.trim(index_line(F.col("text"))), " "), lambda w: w != "")
    pairs = F.transform(words, lambda w, i: F.struct(w.alias("term"), i.alias("at")))
    return docs.select("doc_id", _runs(pairs, lambda ats: ats).alias("postings"))


def postings(index: DataFrame) -> DataFrame:
    """(term, doc_id, positions), a row for each term of each page."""
    return index.select("doc_id", F.inline("postings")).select("term", "doc_id", "positions")


def fold_index(index: DataFrame, of: str = "éèê", to: str = "eee") -> DataFrame:
    """index with the letters of `of` in its terms written as those of `to`; terms of a page that become equal merge their positions."""
    pairs = F.transform("postings", lambda p: F.struct(F.translate(p["term"], of, to).alias("term"), p["positions"].alias("at")))
    return index.select("doc_id", _runs(pairs, lambda ats: F.when(F.size(ats) == 1, F.get(ats, F.lit(0))).otherwise(F.sort_array(F.flatten(ats)))).alias("postings"))


def stored(rows: DataFrame, path: str) -> None:
    """Writes postings in order of the term, so that a query's few terms are found by the bounds that Parquet keeps of each row group."""
    rows.repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").option("parquet.block.size", 8 << 20).parquet(path)
