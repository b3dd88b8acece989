"""Line dedup by a deletion-neighbourhood join; the edit distance counts words, its bound is one edit.

A line is normalised (lower case, words joined by one space). Two lines within one word edit share a variant: delete
the edited word from both (substitution), or from the longer one (insertion). So every variant is emitted as a hashed
key, equal variants meet, and the words are compared before anything goes.

Emitting every variant of every line would cost a copy of the corpus for each word of a line. The halves bound it
without loss: of two lines within one edit, either the first halves are equal or the second halves (with the halves of
the shorter line), so only lines that share a half with another line emit their variants.

The earliest line by (document id, hash of its text, line number) stays. A line goes if it repeats an earlier line or is
within one edit of any earlier line. Variants are keyed by (hash, place of the edit): all lines of a key are within one
edit of each other, so comparing each with the earliest of its key finds every line that has an earlier neighbour, and
no pairs within a group are made. Lines that repeat an earlier one go whatever their length; they are told by 128 bits of
hashes. Lines under MIN_WORDS words have no neighbours: at few words one edit makes another line. A min_words that is
given holds for both rules. Empty lines stay.

Defined cases: a null text has no lines and stays null; null ids come before all others, in an order that their texts'
hashes give; rows with one id and different texts are documents of their own; of repeated rows (same id and text) one
is the earliest and the lines of the others repeat its lines; empty tables give empty results; texts of any length are
read whole; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import boxed, cut, keep, let, n_chars, plain_lines

MIN_WORDS = 8


def _first(line: Column, n: Column) -> Column:
    return F.call_function("substring_index", line, F.lit(" "), n)


def _count(line: Column) -> Column:
    return n_chars(line, " ") + 1


def key_of(id_col: str, text: str) -> dict[str, Column]:
    """d, t: the id and a hash of the text. For a null id, d is another hash of the text, below all ids."""
    return {"d": F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 62)) - F.shiftrightunsigned(F.xxhash64(F.lit(1), F.col(text)), 2)), "t": F.xxhash64(text)}


def least_words(min_words: int | None) -> tuple[int, int]:
    """Words that a line must have to get neighbours, and to go as a repeat."""
    return (MIN_WORDS, 1) if min_words is None else (min_words, min_words)


def line_rows(docs: DataFrame, id_col: str, text: str, min_words: int) -> DataFrame:
    """(d, t, i, m, line, lh, lc) of the lines of min_words words or more, and one at least.

    d and t are the key of the document, m its number of such lines, lh and lc hashes of the line.
    """
    fits = lambda x: (x != "") if min_words < 2 else (x != "") & (n_chars(x, " ") >= min_words - 1)
    rows = docs.select(*[c.alias(k) for k, c in key_of(id_col, text).items()], plain_lines(F.col(text)).alias("lines"))
    # a step of its own, or the whole array would go along with each of its lines
    rows = rows.select("d", "t", F.size(F.filter("lines", fits)).alias("m"), "lines")
    # the outer form, as Spark infers from the other one a filter that splits every text again
    rows = rows.select("d", "t", "m", F.posexplode_outer("lines").alias("i", "line"))
    return rows.filter(fits(F.col("line"))).select("d", "t", "i", "m", "line", F.xxhash64("line").alias("lh"), F.xxhash64(F.lit(1), "line").alias("lc"))


def half_keys(line: Column) -> Column:
    """Hashes of both halves as of a line of this length and of one word less."""

    def keys(n: Column) -> Column:
        out = []
        for m in (n, n - 1):
            a = F.shiftright(m, 1)
            out += [F.xxhash64(F.lit("a"), m, _first(line, a)), F.xxhash64(F.lit("b"), m, _first(line, a - m))]
        return F.array(*out)

    return let(_count(line), keys)


def _without(line: Column, i: Column, n: Column) -> Column:
    """line, of n words, without its word i."""
    return F.trim(F.concat(_first(line, i), F.lit(" "), _first(line, i + 1 - n)))


def variants_of(line: Column, first: Column, second: Column) -> Column:
    """(at, hash) of the line without that word, for the words of the first and of the second half, as asked for."""

    def run(n: Column) -> Column:
        half = F.shiftright(n, 1)
        lo, hi = F.when(first, 0).otherwise(F.shiftright(n - 1, 1)), F.when(second, n - 1).otherwise(n - half - 1)
        return F.transform(F.sequence(lo, hi), lambda i: F.struct(i.alias("at"), F.xxhash64(_without(line, i, n)).alias("v")))

    return let(_count(line), run)


def line_index(docs: DataFrame, id_col: str, text: str, min_words: int | None) -> DataFrame:
    """(d, t, i, m, lh, lc, keys): the lines by hash, written once for all that follows. Lines too short for neighbours have no keys."""
    near, exact = least_words(min_words)
    keys = half_keys(F.col("line"))
    if exact < near:
        keys = F.when(n_chars(F.col("line"), " ") >= near - 1, keys)
    return keep(line_rows(docs, id_col, text, exact).select("d", "t", "i", "m", "lh", "lc", keys.alias("keys")))


AT = ["d", "t", "i"]
BY = ["bd", "bt", "bi"]


def removed_lines(docs: DataFrame, index: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int | None = None) -> DataFrame:
    """(lh, lc, first): lines that repeat or have an earlier neighbour, by their hashes. first is the occurrence that stays, else null."""
    keys = index.select("lh", F.posexplode("keys").alias("side", "k"))
    shared = keys.groupBy("k").agg(F.min("lh").alias("lo"), F.max("lh").alias("hi")).filter("lo < hi").select("k")
    # lines that share a first half differ in the second, and the other way round
    hit = keys.join(cut(shared), "k", "left_semi").groupBy("lh").agg(F.max(F.col("side") % 2 == 1).alias("in_first"), F.max(F.col("side") % 2 == 0).alias("in_second"))
    firsts = keep(index.groupBy("lh", "lc").agg(F.min(F.struct(*AT)).alias("first"), F.count("*").alias("n")))
    # the words of each such line, from where it stands first; a line is known by that place from here on
    places = hit.join(firsts, "lh").select("lh", "lc", "first", "in_first", "in_second")
    lines = line_rows(docs, id_col, text, least_words(min_words)[0]).select(F.col("lh").alias("own"), "line", *AT)
    stands = (F.col("own") == F.col("lh")) & (F.col("d") == F.col("first.d")) & (F.col("t") == F.col("first.t")) & (F.col("i") == F.col("first.i"))
    near = keep(lines.join(places, stands).dropDuplicates(["lh", "lc"]).select(*AT, "lh", "line", "in_first", "in_second"))
    variants = keep(near.select(*AT, F.inline(variants_of(F.col("line"), F.col("in_first"), F.col("in_second")))))
    place = F.struct(*AT)
    starred = variants.groupBy("v", "at").agg(F.min(place).alias("lead"), F.max(place).alias("last")).filter("lead < last").select("v", "at", "lead")
    named = lambda s, names: [F.col(s)[k].alias(n) for k, n in zip(AT, names, strict=True)]
    same = variants.join(starred, ["v", "at"]).filter(place != F.col("lead")).select(*AT, *named("lead", BY), "at", F.lit(True).alias("both"))
    # a line equal to a variant of another is within one edit of it, whatever the place
    shorter = variants.join(near.select(F.col("lh").alias("v"), place.alias("whole")), "v").withColumn("long", place)
    longer_goes = shorter.filter("whole < long").select(*AT, *named("whole", BY), "at", F.lit(False).alias("both"))
    shorter_goes = shorter.filter("whole > long").select(*named("whole", AT), *named("long", BY), "at", F.lit(None).cast("boolean").alias("both"))
    pairs = same.unionByName(longer_goes).unionByName(shorter_goes).dropDuplicates([*AT, *BY])
    a, b = near.select(*AT, F.col("line").alias("a")), near.select(*[F.col(k).alias(n) for k, n in zip(AT, BY, strict=True)], F.col("line").alias("b"))
    checked = pairs.join(a, AT).join(b, BY)
    x = F.when(F.col("both").isNull(), F.col("a")).otherwise(_without(F.col("a"), F.col("at"), _count(F.col("a"))))
    y = F.when(F.col("both").isNull() | F.col("both"), _without(F.col("b"), F.col("at"), _count(F.col("b")))).otherwise(F.col("b"))
    gone = checked.filter(x == y).select(AT).distinct().withColumn("near", F.lit(True))
    marked = firsts.select("lh", "lc", "n", "first.*").join(gone, AT, "left").filter("n > 1 OR near")
    return marked.select("lh", "lc", F.when(F.col("near").isNull(), F.struct(*AT)).alias("first"))


def dropped(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(kd, kt, gone): for each document that loses lines, their numbers.

    And (kd, kt, every) of documents that stand in several equal rows, with the numbers of all their lines; None if there are none.
    """
    index = line_index(docs, id_col, text, min_words)
    out = cut(removed_lines(docs, index, id_col, text, min_words).select(F.col("lh").alias("lh2"), F.col("lc").alias("lc2"), "first"))
    gone = index.join(out, (F.col("lh") == F.col("lh2")) & (F.col("lc") == F.col("lc2"))).filter(F.col("first").isNull() | (F.struct(*AT) != F.col("first")))
    key = [F.col("d").alias("kd"), F.col("t").alias("kt")]
    lost = gone.groupBy(*key).agg(F.collect_set("i").alias("gone"))
    copies = cut(index.groupBy(*key).agg(F.count("*").alias("n"), F.max("m").alias("m")).filter("n > m").select("kd", "kt"))
    if copies.isEmpty():
        return lost, None
    return lost, index.join(copies, (F.col("d") == F.col("kd")) & (F.col("t") == F.col("kt")), "left_semi").groupBy(*key).agg(F.collect_set("i").alias("every"))


def with_lost(own: DataFrame, found: tuple[DataFrame, DataFrame | None]) -> DataFrame:
    """own (with d and t) and the numbers of the lines that each row loses, or null. Of equal rows all but one lose every line."""
    lost, copies = found
    on = (F.col("d") == F.col("kd")) & (F.col("t") == F.col("kt"))
    out = own.join(lost, on, "left").drop("kd", "kt")
    if copies is None:
        return out.drop("d", "t")
    # written with a number for each row, so that all see the same one stay
    several = keep(out.join(copies, on).drop("kd", "kt").withColumn("uid", F.monotonically_increasing_id()))
    stays = several.groupBy("d", "t").agg(F.min("uid").alias("least")).select("least")
    several = several.join(stays, F.col("uid") == F.col("least"), "left").withColumn("gone", F.when(F.col("least").isNull(), F.col("every")).otherwise(F.col("gone")))
    return out.join(copies, on, "left_anti").unionByName(several.drop("every", "uid", "least")).drop("d", "t")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int | None = None) -> DataFrame:
    """docs with the lines taken out of the text. Documents without a word left, that had some, go."""
    out = with_lost(boxed(docs, **key_of(id_col, text)), dropped(docs, id_col, text, min_words))
    whole = F.col("row")[text]
    left = F.array_join(F.filter(F.transform(F.split(whole, "\n"), lambda x, i: F.when(~F.array_contains("gone", i), x)), lambda x: x.isNotNull()), "\n")
    out = out.withColumn("left", F.when(F.col("gone").isNull(), whole).otherwise(left)).filter(F.col("gone").isNull() | F.col("left").rlike(r"[^\x20\x09-\x0D]"))
    return out.select(*[(F.col("left") if c == text else F.col("row")[c]).alias(c) for c in docs.columns])


def line_report(docs: DataFrame, id_col: str = "doc_id", text: str = "text", min_words: int | None = None) -> DataFrame:
    """One row for each document: doc_id, n_lines, n_removed, removed (line numbers, comma-joined)."""
    own = docs.select(F.col(id_col).alias("doc_id"), *[c.alias(k) for k, c in key_of(id_col, text).items()], F.coalesce(F.size(F.split(text, "\n")), F.lit(0)).cast("long").alias("n_lines"))
    rows = with_lost(own, dropped(docs, id_col, text, min_words))
    n = F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long")
    return rows.select("doc_id", "n_lines", n.alias("n_removed"), F.coalesce(F.array_join(F.sort_array("gone"), ","), F.lit("")).alias("removed"))


#: The same rows: all repeats of a line, and every deletion variant of every line of 8 words or more, then all pairs with a common one.
SQL = r"""
WITH l AS (SELECT doc_id AS d, i - 1 AS i, list_transform(regexp_extract_all(string_split(text, chr(10))[i], '[^\x20\x09-\x0D]+'), lambda x: lower(x)) AS w
           FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS r(i)),
e AS (SELECT d, i, w, list_aggregate(w, 'string_agg', ' ') AS s FROM l WHERE len(w) >= 1),
f AS (SELECT s, any_value(w) AS w, min({'d': d, 'i': i}) AS first FROM e GROUP BY s),
n AS (SELECT * FROM f WHERE len(w) >= 8),
v AS (SELECT s, first, j, list_aggregate(list_concat(w[1:j-1], w[j+1:]), 'string_agg', ' ') AS v FROM n, unnest(range(1, len(w) + 1)) AS r(j)),
g AS (SELECT s FROM v QUALIFY first > min(first) OVER (PARTITION BY v, j)
      UNION SELECT v.s FROM v JOIN n ON v.v = n.s WHERE n.first < v.first UNION SELECT n.s FROM v JOIN n ON v.v = n.s WHERE n.first > v.first),
x AS (SELECT e.d, e.i FROM e JOIN f USING (s) LEFT JOIN g USING (s) WHERE g.s IS NOT NULL OR first <> {'d': e.d, 'i': e.i}),
o AS (SELECT d, count(*) AS n, string_agg(i::VARCHAR, ',' ORDER BY i) AS r FROM (SELECT DISTINCT * FROM x) GROUP BY d)
SELECT doc_id, coalesce(len(string_split(text, chr(10))), 0)::BIGINT AS n_lines, coalesce(n, 0)::BIGINT AS n_removed, coalesce(r, '') AS removed
FROM documents LEFT JOIN o ON doc_id = d
"""
