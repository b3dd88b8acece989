"""Search queries on the library's operators, and SQL that was written apart from them.

Pages are documents, books their sources; a few Arabic pages are added, as the tables hold none.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import postings, ranks, search
from ..sources.tables import read

#: (page id, text) of a book of its own.
ARABIC = ((-4, "ويُستحبُّ الاغتسالُ ليلاً في شهر رمضان."), (-3, "وكذلك الاغتسال بالليل للمرأة، ويجوز اغتسالها بالليل."), (-2, "قال الإمامُ الصادقُ عليه السلام: والليلِ إذا يغشى."), (-1, "الاغتسالُ  بِاللَّيل أفضل، ثم الاغتسال بالليل سنة ١٤٠٢"))
HEADINGS = ((-3, "بابُ الطهارةِ"), (-2, "كتاب الإمامة والخلافة"), (-1, "The Book of the Night"))
OPTIONS = {"page": 2, "limit": 20, "languages": ["en"], "works": [3]}


def pages(spark, sf_dir):
    """page_id, book, sequence, text."""
    more = spark.createDataFrame([(i, "arabic", t) for i, t in ARABIC], "page_id long, book string, text string")
    ids = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("book"))
    # numbers come from ids alone; texts stay where they are read
    at = ranks.numbered(ids.unionByName(more.select("page_id", "book")), "book", "page_id").select("page_id", "sequence")
    whole = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("source").alias("book"), "text").unionByName(more)
    return whole, at


def books(spark, sf_dir):
    """book, rank and attributes that stand on the number in a source's name."""
    n = F.coalesce(F.regexp_extract("book", "[0-9]+", 0).try_cast("int"), F.lit(0))
    own = read(spark, sf_dir, "documents").select(F.col("source").alias("book")).union(spark.createDataFrame([("arabic",)], "book string")).distinct().withColumn("n", n)
    own = own.select("book", (F.col("n") % 10).alias("work_id"), (F.col("n") % 5).alias("author_id"), F.when(F.col("n") % 2 == 0, "en").otherwise("de").alias("language"), F.array(F.col("n") % 3, F.col("n") % 4).alias("subjects"), F.array(F.col("n") % 2).alias("libraries"), F.concat(F.lit("title "), (F.col("n") % 7).cast("string")).alias("title"), (F.col("n") * 37 % 101).alias("year"), F.when(F.col("n") % 3 > 0, F.col("n") % 3).alias("volume"))
    return ranks.ranked(own, [F.col("year"), F.col("title"), F.col("work_id"), F.col("volume").asc_nulls_first(), F.col("book")], "rank")


def index(spark, sf_dir):
    whole, _ = pages(spark, sf_dir)
    return search.indexed(whole)


def _hits(found, spark, sf_dir, *columns):
    """Numbers go to the pages that were found, not to all texts."""
    return found.select("page_id", "book", *columns).join(pages(spark, sf_dir)[1], "page_id")


def phrase_search(spark, sf_dir):
    return _hits(search.phrase_pages(index(spark, sf_dir), "Of THE"), spark, sf_dir).select("book", "sequence", "page_id")


def arabic_search(spark, sf_dir):
    return _hits(search.phrase_pages(index(spark, sf_dir), "الإغتسال باللّيل"), spark, sf_dir).select("book", "sequence", "page_id")


def all_words(spark, sf_dir):
    return search.all_word_pages(index(spark, sf_dir), "and THE of").select("page_id")


def phrase_tf(spark, sf_dir):
    hits = search.phrase_pages(index(spark, sf_dir), "of the")
    return hits.select("page_id", search.occurrences(F.col("line"), "of the").alias("n"), search.score(F.col("line"), "of the").alias("score"))


def postings_phrase(spark, sf_dir):
    found = postings.postings(postings.page_index(read(spark, sf_dir, "documents")))
    return search.postings_phrase(found, "of the")


def search_full(spark, sf_dir):
    whole, at = pages(spark, sf_dir)
    # the numbers of pages that are found meet their ids; no text is dealt for them
    found = search.phrase_pages(search.indexed(whole), "of the").select("page_id", "book", "line").join(at, "page_id")
    out = search.search(whole, books(spark, sf_dir), "of the", index=found, **OPTIONS)
    return out.select("page_id", "book", "sequence", "position", "snippet", "start", "end", "score", "total")


def total_compat(spark, sf_dir):
    i = index(spark, sf_dir)
    counts = None
    for q in ("the", "of the", "no such words"):
        n = search.phrase_pages(i, q).agg(F.count("*").alias("n")).select(F.lit(q).alias("query"), "n")
        counts = n if counts is None else counts.unionByName(n)
    return counts.select("query", search.shown_total(F.col("n"), F.least("n", F.lit(1200))).alias("total"))


def hit_decorate(spark, sf_dir):
    found = search.phrase_pages(index(spark, sf_dir), "in the").select("page_id", "book", "line")
    b = books(spark, sf_dir)
    subjects = b.select("book", F.explode(F.array_distinct("subjects")).alias("s")).groupBy("book").agg(F.to_json(F.array_sort(F.collect_list(F.struct(F.col("s").alias("id"), F.concat(F.lit("subject "), F.col("s").cast("string")).alias("title"))))).alias("subjects"))
    head = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), F.col("lang").alias("heading"))
    at = pages(spark, sf_dir)[1].join(b.select("book", "rank").join(found.select("page_id", "book"), "book"), "page_id")
    out = found.withColumn("score", search.score(F.col("line"), "in the")).drop("line").join(at.select("page_id", "sequence", "rank"), "page_id").join(subjects, "book", "left").join(head, "page_id", "left")
    return ranks.with_total(out, found).select("page_id", "book", "sequence", "rank", "subjects", F.col("heading").alias("section"), "score", "total")


def snippet(spark, sf_dir, radius: int = search.RADIUS):
    return search.snippets(read(spark, sf_dir, "documents"), "of the", radius)


def toc(spark, sf_dir):
    """book, ord, heading, sequence: the headings of raw pages, and Arabic ones."""
    p = read(spark, sf_dir, "pages").select((F.col("page_id") % 10).cast("string").alias("book"), F.col("page_id").alias("ord"), F.regexp_extract("html", "<h1[^>]*>([^<]*)", 1).alias("heading"), (F.col("page_id") * 2).alias("sequence"))
    return p.filter("heading <> ''").unionByName(spark.createDataFrame([("0", i, t, 0) for i, t in HEADINGS], "book string, ord long, heading string, sequence long"))


def _labels(spark, sf_dir):
    return read(spark, sf_dir, "pages").filter("page_id % 3 > 0").select((F.col("page_id") % 10).cast("string").alias("book"), (F.col("page_id") * 2).alias("sequence"), F.concat(F.lit("p. "), F.col("page_id").cast("string")).alias("label"))


def _shelf(spark, sf_dir):
    return spark.range(10).select(F.col("id").cast("string").alias("book"), (F.col("id") % 4).cast("int").alias("work_id"), (F.col("id") % 3).cast("int").alias("author_id"), F.when(F.col("id") % 2 == 0, "en").otherwise("de").alias("language"), F.array(F.lit(1)).alias("subjects"), F.array(F.lit(1)).alias("libraries"))


def _headings(query, **options):
    return lambda spark, sf_dir: search.headings(toc(spark, sf_dir), query, _labels(spark, sf_dir), _shelf(spark, sf_dir), **options)


def book_order(spark, sf_dir):
    from .shelves import authors_of, books_of, works_of

    b = books_of(spark, sf_dir).filter("published").join(works_of(spark, sf_dir).select("work_id", "title"), "work_id").join(authors_of(spark, sf_dir).select("author_id", "death_label"), "author_id")
    k = T.order_key(F.col("death_label"), T.first_int(F.col("death_label")))
    own = b.select("book_id", k.alias("k"), T.normalize(F.col("title")).alias("title_norm"), "work_id", "volume")
    return ranks.ranked(own, [F.col("k"), F.col("title_norm"), F.col("work_id"), F.col("volume").asc_nulls_first(), F.col("book_id")]).select("book_id", F.col("k").cast("int").alias("k"), "position")


QUERIES = {
    "phrase_search": phrase_search, "arabic_search": arabic_search, "all_words": all_words, "phrase_tf": phrase_tf, "postings_phrase": postings_phrase, "search_full": search_full,
    "total_compat": total_compat, "hit_decorate": hit_decorate, "snippet": snippet, "passage": lambda spark, d: snippet(spark, d, 650), "book_order": book_order,
    "toc_prefix": _headings("The  bo", limit=1000), "toc_rank": _headings("the", page=2, limit=10), "toc_cap": _headings("t", limit=30, cap=40), "toc_filters": _headings("t", limit=1000, languages=["en"], works=[0, 1], authors=[0, 2]),
    "toc_arabic": _headings("باب الطها"),
}


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def norm_sql(x: str) -> str:
    return f"trim(regexp_replace(lower(translate(regexp_replace(nfc_normalize({x}), {quoted(T.MARKS)}, '', 'g'), {quoted(T.LETTERS_FROM + T.DIGITS_FROM)}, {quoted(T.LETTERS_TO + T.DIGITS_TO)})), {quoted(T.WHITE)}, ' ', 'g'))"


PAGES_SQL = f"""p AS (SELECT doc_id AS page_id, source AS book, text FROM documents UNION ALL SELECT a, 'arabic', b FROM (VALUES {", ".join(f"({i}, {quoted(t)})" for i, t in ARABIC)}) v(a, b)),
s AS (SELECT *, row_number() OVER (PARTITION BY book ORDER BY page_id) AS sequence, list_filter(string_split_regex({norm_sql("text")}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS words FROM p),
l AS (SELECT *, ' ' || array_to_string(words, ' ') || ' ' AS line FROM s)"""
BOOKS_SQL = """n AS (SELECT book, coalesce(try_cast(regexp_extract(book, '[0-9]+') AS INT), 0) AS n FROM (SELECT DISTINCT book FROM p) t),
b AS (SELECT *, row_number() OVER (ORDER BY n * 37 % 101, 'title ' || n % 7, n % 10, CASE WHEN n % 3 > 0 THEN n % 3 END NULLS FIRST, book) AS rank FROM n)"""


def snippet_sql(text: str, words: list[str], radius: int) -> str:
    """A snippet by another way: the place from the part before the first match, then two searches for white space."""
    inner, edge = r"\s+".join(words), r"[^\p{L}\p{N}_]"
    m = rf"'(?is)^((?:.*?{edge})??)({inner})(?:$|{edge})'"
    return f"""(SELECT CASE WHEN ok THEN trim(c, E' \\t\\n\\r\\f\\x0b') ELSE trim(left(t, {2 * radius}), E' \\t\\n\\r\\f\\x0b') END AS snippet,
      CASE WHEN ok THEN a - lo - (length(c) - length(ltrim(c, E' \\t\\n\\r\\f\\x0b'))) END AS "start", CASE WHEN ok THEN z - lo - (length(c) - length(ltrim(c, E' \\t\\n\\r\\f\\x0b'))) END AS "end", page_id FROM (
      SELECT *, substring(t, lo + 1, hi - lo) AS c FROM (SELECT *, length(regexp_replace(left(t, greatest(a - {radius}, 0)), '\\S+$', '')) AS lo, least(z + {radius}, length(t)) + length(regexp_extract(substring(t, least(z + {radius}, length(t)) + 1), '^\\S*')) AS hi FROM (
      SELECT page_id, t, regexp_matches(t, {m}) AS ok, length(regexp_extract(t, {m}, 1)) AS a, length(regexp_extract(t, {m}, 1)) + length(regexp_extract(t, {m}, 2)) AS z FROM (SELECT page_id, {text} AS t FROM h) q0) q1) q2) q3)"""


def _occurrences(words: list[str]) -> str:
    k = len(words)
    same = " AND ".join(f"words[i + {j}] = {quoted(w)}" for j, w in enumerate(words))
    return f"len(list_filter(range(1, greatest(len(words) - {k - 1} + 1, 1)), lambda i: {same}))"


TOC_SQL = f"""t AS (SELECT CAST(page_id % 10 AS VARCHAR) AS book, page_id AS ord, regexp_extract(html, '<h1[^>]*>([^<]*)', 1) AS heading, page_id * 2 AS sequence FROM pages
  UNION ALL SELECT '0', a, b, 0 FROM (VALUES {", ".join(f"({i}, {quoted(x)})" for i, x in HEADINGS)}) v(a, b)),
w AS (SELECT *, {norm_sql("heading")} AS norm FROM t WHERE heading <> ''),
x AS (SELECT *, list_filter(string_split_regex(norm, '[^\\p{{L}}\\p{{N}}]+'), lambda y: y <> '') AS ws, CAST(book AS INT) AS nb FROM w)"""


def _toc_sql(terms: list[str], phrase: str, page: int = 1, limit: int = 50, cap: int = 5000, where: str = "true") -> str:
    each = " AND ".join(f"len(list_filter(ws, lambda y: starts_with(y, {quoted(t)}))) > 0" for t in terms)
    return f"""WITH {TOC_SQL}, c AS (SELECT * FROM x WHERE {each} AND {where} ORDER BY book, ord LIMIT {cap}),
r AS (SELECT *, row_number() OVER (ORDER BY norm = {quoted(phrase)} DESC, starts_with(norm, {quoted(phrase)}) DESC, length(norm), book, ord) AS position, count(*) OVER () AS total FROM c)
SELECT r.book, ord, heading, sequence, CASE WHEN page_id % 3 > 0 THEN 'p. ' || page_id END AS label, position, total, total >= {cap} AS capped
FROM r LEFT JOIN pages ON CAST(page_id % 10 AS VARCHAR) = r.book AND page_id * 2 = sequence WHERE position > {(page - 1) * limit} AND position <= {page * limit}"""


SQL = {
    "phrase_search": f"WITH {PAGES_SQL} SELECT book, sequence, page_id FROM l WHERE contains(line, ' of the ')",
    "arabic_search": f"WITH {PAGES_SQL} SELECT book, sequence, page_id FROM l WHERE contains(line, ' الاغتسال بالليل ')",
    "all_words": f"WITH {PAGES_SQL} SELECT page_id FROM l WHERE list_has_all(words, ['and', 'of', 'the'])",
    "phrase_tf": f"WITH {PAGES_SQL} SELECT page_id, n, round(n * 0.1::DOUBLE, 4) AS score FROM (SELECT page_id, {_occurrences(['of', 'the'])} AS n FROM l) t WHERE n > 0",
    "postings_phrase": r"WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS words FROM documents) SELECT * FROM (SELECT doc_id, " + _occurrences(["of", "the"]) + " AS n FROM d) t WHERE n > 0",
    "search_full": f"""WITH {PAGES_SQL}, {BOOKS_SQL}, h AS (SELECT page_id, l.book, sequence, rank, text, words FROM l JOIN b ON b.book = l.book WHERE contains(line, ' of the ') AND (n % 2 = 0 OR n % 10 = 3)),
r AS (SELECT *, row_number() OVER (ORDER BY rank, sequence) AS position, count(*) OVER () AS total FROM h)
SELECT r.page_id, book, sequence, position, snippet, "start", "end", round({_occurrences(['of', 'the'])} * 0.1::DOUBLE, 4) AS score, CASE WHEN total > 1000 THEN 1000 ELSE total END AS total
FROM r JOIN {snippet_sql("text", ["of", "the"], 90)} z ON z.page_id = r.page_id WHERE position BETWEEN 21 AND 40""",
    "total_compat": f"WITH {PAGES_SQL}, c AS (SELECT q, (SELECT count(*) FROM l WHERE contains(line, ' ' || q || ' ')) AS n FROM (VALUES ('the'), ('of the'), ('no such words')) v(q)) SELECT q AS query, CASE WHEN n <= 1000 THEN n WHEN n < 1200 THEN n ELSE 1200 END AS total FROM c",
    "hit_decorate": f"""WITH {PAGES_SQL}, {BOOKS_SQL} SELECT l.page_id, l.book, sequence, rank, CASE WHEN n % 3 = n % 4 THEN '[{{"id":' || n % 3 || ',"title":"subject ' || n % 3 || '"}}]'
  ELSE '[{{"id":' || least(n % 3, n % 4) || ',"title":"subject ' || least(n % 3, n % 4) || '"}},{{"id":' || greatest(n % 3, n % 4) || ',"title":"subject ' || greatest(n % 3, n % 4) || '"}}]' END AS subjects,
  lang AS section, round({_occurrences(['in', 'the'])} * 0.1::DOUBLE, 4) AS score, count(*) OVER () AS total FROM l JOIN b ON b.book = l.book LEFT JOIN documents ON doc_id = page_id WHERE contains(line, ' in the ')""",
    "book_order": """WITH a AS (SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 THEN 99999 WHEN s_nationkey % 3 = 1 THEN s_nationkey * 100 - 50 ELSE 300 + s_nationkey END AS k FROM supplier)
SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR), CAST(CAST(l_shipdate AS DATE) AS VARCHAR)) AS book_id, k,
row_number() OVER (ORDER BY k, lower(p_name), p_partkey, l_linenumber NULLS FIRST, book_id) AS position FROM lineitem JOIN part ON p_partkey = l_partkey JOIN a ON s_suppkey = l_suppkey WHERE l_returnflag <> 'R'""",
    "toc_prefix": _toc_sql(["the", "bo"], "the bo", limit=1000),
    "toc_rank": _toc_sql(["the"], "the", page=2, limit=10),
    "toc_cap": _toc_sql(["t"], "t", limit=30, cap=40),
    "toc_filters": _toc_sql(["t"], "t", limit=1000, where="nb % 2 = 0 AND nb % 4 IN (0, 1) AND nb % 3 IN (0, 2)"),
    "toc_arabic": _toc_sql(["باب", "الطها"], "باب الطها"),
}
for name, radius in (("snippet", 90), ("passage", 650)):
    SQL[name] = f"""WITH h AS (SELECT doc_id AS page_id, text FROM documents WHERE contains(' ' || array_to_string(list_filter(string_split_regex({norm_sql("text")}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> ''), ' ') || ' ', ' of the '))
SELECT page_id AS doc_id, snippet, "start", "end" FROM {snippet_sql("text", ["of", "the"], radius)} z"""
_NAMESPACE = uuid.NAMESPACE_URL.hex
SQL["point_id"] = f"""WITH h AS (SELECT doc_id, sha1(unhex('{_NAMESPACE}') || encode(source || ':' || doc_id || ':0')) AS h FROM documents) SELECT doc_id,
  h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || CASE WHEN h[17] IN ('0', '4', '8', 'c') THEN '8' WHEN h[17] IN ('1', '5', '9', 'd') THEN '9' WHEN h[17] IN ('2', '6', 'a', 'e') THEN 'a' ELSE 'b' END || h[18:20] || '-' || h[21:32] AS point_id FROM h"""
