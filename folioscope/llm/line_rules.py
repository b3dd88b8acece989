"""Quality rules: cross-document line frequency.

Lines are normalised (trimmed, lower case, inner white space as one space) and hashed. A line counts once for each
document of a host that holds it. Lines of more documents than the host's limit are removed, and a document that loses
more than a given share of its words is rejected. Everything is DataFrame expressions.

Defined cases: a null text is empty and fails the base rule; a null host is a host of its own; repeated rows are
documents of their own; texts of any length are read whole, one text in one task; an empty table gives an empty result;
columns other than those named are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, boxed, keep, let, n_chars, plain_lines, words

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"


def line_hashes(text: Column) -> Column:
    """(hash, words) of each line that has a word, in order."""
    lines = F.filter(plain_lines(text), lambda x: x != "")
    return F.transform(lines, lambda x: F.struct(F.xxhash64(x).alias("h"), (n_chars(x, " ") + 1).alias("n")))


def repeat_words(w: Column, bits: int = 21) -> Column:
    """Words that lie in a three-word window found twice or more in the array w.

    Windows are ordered as (upper bits of the hash | position) in one array of longs; equal neighbours are told by
    their full hashes. Positions are then merged, so the cost is that of one sort for each document. A position has
    `bits` bits there. Texts of more than 2^bits windows, and texts in which different windows agree in the upper bits,
    are ordered as structs of (hash, position), which have no limit.
    """

    def paired(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
        return let(
            order,
            lambda o: let(
                F.struct(o["h"].alias("h"), o["at"].alias("at")),
                lambda q: F.sort_array(F.filter(F.transform(q["at"], lambda x, i: F.when(F.get(q["h"], i).eqNullSafe(F.get(q["h"], i + 1)) | ((i > 0) & F.get(q["h"], i).eqNullSafe(F.get(q["h"], i - 1))), x)), lambda x: x.isNotNull())),
            ),
        )

    def tagged(h: Column) -> Column:
        order = F.sort_array(F.transform(h, lambda x, i: F.shiftleft(F.shiftright(x, bits), bits).bitwiseOR(i.cast("long"))))
        at = lambda x: x.bitwiseAND(F.lit((1 << bits) - 1)).cast("int")
        same = lambda g, i: g[i].eqNullSafe(F.get(g, i + 1)) | ((i > 0) & g[i].eqNullSafe(F.get(g, i - 1)))
        clash = lambda g: F.exists(F.transform(g, lambda x, i: (x != F.get(g, i + 1)) & (F.shiftright(x, bits) == F.shiftright(F.get(g, i + 1), bits))), lambda x: x)
        return let(
            F.transform(order, at),
            lambda p: let(
                F.transform(p, lambda x: F.get(h, x)),
                lambda g: F.when(clash(g), paired(h)).otherwise(F.sort_array(F.filter(F.transform(p, lambda x, i: F.when(same(g, i), x)), lambda x: x.isNotNull()))),
            ),
        )

    def covered(p: Column) -> Column:
        gaps = F.transform(p, lambda x, i: F.coalesce(F.least(F.get(p, i + 1) - x, F.lit(3)), F.lit(3)).cast("long"))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    windows = F.transform(w, lambda x, i: F.when(i < F.size(w) - 2, F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2))))
    whole = F.when(F.size(w) < 3, F.array().cast("array<long>")).otherwise(F.slice(windows, F.lit(1), F.greatest(F.size(w) - 2, F.lit(1))))
    return let(whole, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(let(F.when(F.size(h) > 1 << bits, paired(h)).otherwise(tagged(h)), covered)))


def base_columns(text: Column) -> dict[str, Column]:
    t = F.coalesce(text, F.lit(""))
    counted = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).alias("n_repeat_words")))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD))
    return {
        "counted": counted,
        "word_chars": (F.length(t) - n_chars(t, BLANKS)).cast("long"),
        "n_symbols": n_chars(t, SYMBOLS).cast("long"),
        "n_dup_lines": let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")),
    }


def hashed_lines(docs: DataFrame, text: str = "text", host: str = "source", **more: Column) -> DataFrame:
    """(host, lines, more): the lines of each document as (hash, words), written once for all that counts them."""
    return keep(docs.select(F.col(host).alias("host"), line_hashes(F.col(text)).alias("lines"), *[c.alias(k) for k, c in more.items()]))


def frequent_lines(hashed: DataFrame, min_docs: int = 20, share: float = 0.02) -> DataFrame:
    """(host, h, n_docs) of the lines in more than max(min_docs, share of the host's documents) documents.

    Counts are pre-aggregated on the map side; a hot host or line sends one row for each task. The rows are bounded by
    (lines of a document) / share for each host.
    """
    own = hashed.select("host", F.explode(F.array_distinct(F.col("lines")["h"])).alias("h"))
    sizes = hashed.groupBy(F.col("host").alias("of")).agg(F.count("*").alias("docs"))
    counts = own.groupBy("host", "h").agg(F.count("*").alias("n_docs")).filter(F.col("n_docs") > min_docs)
    return counts.join(sizes, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("n_docs") > F.col("docs") * share).select("host", "h", "n_docs")


def line_frequency(docs: DataFrame, id_col: str = "doc_id", text: str = "text", host: str = "source", min_docs: int = 20, share: float = 0.02, lost: float = 0.5) -> DataFrame:
    """One row for each document: id, base counts, base_failed, words in removed lines, kept."""
    tag = F.xxhash64(text)
    base = base_columns(F.col(text))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(host).alias("host"), tag.alias("tag"), *[c.alias(k) for k, c in base.items()])
    rows = rows.select("doc_id", "host", "tag", F.col("counted.n_words").alias("n_words"), "word_chars", "n_symbols", "n_dup_lines", F.col("counted.n_repeat_words").alias("n_repeat_words"))
    hashed = hashed_lines(docs, text, host, d=F.col(id_col), t=tag)
    often = frequent_lines(hashed, min_docs, share)
    lines = hashed.select("d", F.col("host").alias("s"), "t", F.explode("lines").alias("line")).select("d", "s", "t", F.col("line.h").alias("lh"), F.col("line.n").alias("n"))
    gone = lines.join(often, (F.col("lh") == F.col("h")) & F.col("s").eqNullSafe(F.col("host"))).groupBy("d", "s", "t").agg(F.sum("n").alias("gone"))
    # repeated rows are equal in d, s and t; the sum then holds each of them once, so it is shared out by their number
    same = hashed.groupBy(F.col("d").alias("d2"), F.col("host").alias("s2"), F.col("t").alias("t2")).agg(F.count("*").alias("times")).filter("times > 1")
    gone = gone.join(same, F.col("d").eqNullSafe(F.col("d2")) & F.col("s").eqNullSafe(F.col("s2")) & F.col("t").eqNullSafe(F.col("t2")), "left").select("d", "s", "t", (F.col("gone") / F.coalesce("times", F.lit(1))).cast("long").alias("gone"))
    out = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("host").eqNullSafe(F.col("s")) & F.col("tag").eqNullSafe(F.col("t")), "left")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    removed = F.coalesce("gone", F.lit(0)).cast("long")
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (removed <= F.col("n_words") * lost)).alias("kept"), removed.alias("removed_words"))


def clean_lines(docs: DataFrame, text: str = "text", host: str = "source", min_docs: int = 20, share: float = 0.02) -> DataFrame:
    """docs without the lines that are over their host's limit; other columns stay as they are."""
    often = frequent_lines(hashed_lines(docs, text, host), min_docs, share).groupBy("host").agg(F.collect_set("h").alias("often"))
    out = boxed(docs, of=F.col(host)).join(often, F.col("of").eqNullSafe(F.col("host")), "left")
    plain = lambda x: F.xxhash64(F.array_join(words(F.lower(x)), " "))
    none = F.array().cast("array<long>")
    kept = F.array_join(F.filter(F.split(F.col("row")[text], "\n"), lambda x: ~F.array_contains(F.coalesce("often", none), plain(x))), "\n")
    return out.select(*[kept.alias(c) if c == text else F.col("row")[c].alias(c) for c in docs.columns])


#: The same rows by counting whole lines and windows.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w FROM d),
win AS (SELECT k, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g FROM w, unnest(range(1, len(w) - 1)) AS r(i)),
dup AS (SELECT k, i FROM win QUALIFY count(*) OVER (PARTITION BY k, g) > 1),
rep AS (SELECT k, count(DISTINCT i + j) AS n FROM dup, (VALUES (0), (1), (2)) v(j) GROUP BY k),
l AS (SELECT k, source, line, list_aggregate(list_transform(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: lower(x)), 'string_agg', ' ') AS n,
        len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS c
      FROM (SELECT k, source, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
o AS (SELECT l.source, n, count(DISTINCT k) AS nd FROM l GROUP BY ALL),
h AS (SELECT source, count(*) AS c FROM d GROUP BY source),
f AS (SELECT o.source, o.n FROM o JOIN h ON o.source IS NOT DISTINCT FROM h.source WHERE nd > 20 AND nd > h.c * 0.02),
g AS (SELECT k, sum(c) AS gone FROM l JOIN f ON l.n = f.n AND l.source IS NOT DISTINCT FROM f.source GROUP BY k),
x AS (SELECT k, count(*) - count(DISTINCT line) AS dl FROM l GROUP BY k),
r AS (SELECT doc_id, len(w.w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(dl, 0)::BIGINT AS n_dup_lines,
        coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(gone, 0)::BIGINT AS removed_words
      FROM d JOIN w USING (k) LEFT JOIN rep USING (k) LEFT JOIN g USING (k) LEFT JOIN x USING (k))
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed_words <= n_words * 0.5 AS kept
FROM r
"""
