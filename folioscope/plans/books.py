"""Queries on sources, pages, names and retrieval, on stand-ins built from the input's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions import text as T
from ..operators import folds, search, vectors
from ..sources import books, marked
from ..sources.tables import read


def marked_files(spark, sf_dir: str) -> DataFrame:
    """Each document as a marked-up file of one page; in every eleventh a footnote stays open."""
    d = read(spark, sf_dir, "documents")
    tag = lambda name, value: F.concat(F.lit(f"< {name} > "), value, F.lit(f" < / {name} >\n"))
    tail = F.when(F.col("doc_id") % 11 == 0, "\n< هامش > open").otherwise(f"\n< / {marked.BODY} >")
    text = F.concat(F.lit("sum\n"), tag(marked.TITLE, F.col("source")), tag("طبعة", F.col("lang")), F.lit(f"< {marked.BODY} >\n"), tag("صفحة", (F.col("doc_id") % 7).cast("string")), F.coalesce("text", F.lit("")), tail)
    return d.select(F.col("doc_id").alias("book_id"), F.encode(text, "UTF-8").alias("content"))


def src_decode(spark, sf_dir):
    @F.pandas_udf(T.StringType())
    def decoded(raw):
        return raw.map(marked.decode)

    return marked_files(spark, sf_dir).select("book_id", F.md5(decoded("content")).alias("text_md5"))


def parse_header(spark, sf_dir):
    return marked.parse_files(marked_files(spark, sf_dir)).filter("ok").select(F.col("book_id").cast("long").alias("book_id"), F.col("book.title").alias("title"), F.col("book.metadata")["edition"].alias("edition"))


def parse_body(spark, sf_dir):
    b = marked.parse_files(marked_files(spark, sf_dir)).filter("ok").select("book.*")
    return books.page_rows(b).select("book_id", "sequence", "page_number", F.md5("text").alias("text_md5"), F.size("block_offsets").alias("n_blocks"))


def import_log(spark, sf_dir):
    return marked.parse_files(marked_files(spark, sf_dir)).select(F.col("book_id").cast("long").alias("book_id"), "ok", "stage")


def talks(spark, sf_dir) -> DataFrame:
    """Each conversation as a book: a page for each turn, the role as a first block, a heading where the user speaks."""
    turns = read(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    page_id = lambda i: F.format_string("p-%06d", i + 1)
    block = lambda i, k, kind, text: F.struct(F.format_string(f"p-%06d-b-{k:03d}", i + 1).alias("id"), F.lit(kind).alias("type"), F.lit(k).alias("order"), text.alias("text"), F.lit(None).cast("string").alias("tocId"))
    page = lambda x, i: F.struct(page_id(i).alias("id"), (i + 1).alias("sequence"), F.lit(False).alias("isBlank"), (i + 1).cast("string").alias("pageNumber"), F.lit("main").alias("pageType"), F.array(block(i, 1, "text", x["role"]), block(i, 2, "text", x["text"])).alias("blocks"))
    heads = F.filter(F.transform("t", lambda x, i: F.struct(page_id(i).alias("pageId"), (x["role"] == "user").alias("is"))), lambda e: e["is"])
    toc = F.transform(heads, lambda e, k: F.struct(F.format_string("toc-%05d", k + 1).alias("id"), (k + 1).alias("order"), F.lit("turn").alias("title"), e["pageId"].alias("pageId")))
    return turns.select(F.lit(2).alias("schemaVersion"), F.col("conv_id").cast("string").alias("bookId"), F.lit("talk").alias("title"), F.lit("").alias("author"), F.transform("t", page).alias("pages"), toc.alias("toc"))


def src_book_json(spark, sf_dir):
    raw = talks(spark, sf_dir).select(F.to_json(F.struct("*")).alias("j")).select(F.from_json("j", books.BOOK).alias("b"))
    return raw.select(F.col("b.bookId").cast("long").alias("conv_id"), F.size("b.pages").cast("long").alias("n_pages"))


def paginate(spark, sf_dir):
    p = books.page_rows(talks(spark, sf_dir))
    return p.select(F.col("book_id").cast("long").alias("conv_id"), F.col("sequence").cast("long").alias("sequence"), F.md5("text").alias("text_md5"), F.array_join(F.transform("block_offsets", lambda x: x.cast("string")), ",").alias("offsets"), F.col("section_ord").cast("long").alias("section_ord"))


def book_issues(spark, sf_dir):
    found = books.issues(talks(spark, sf_dir))
    return found.select(F.col("book_id").cast("long").alias("conv_id"), "severity", "code", "n")


def vec_decode_f16(spark, sf_dir):
    v = read(spark, sf_dir, "embeddings").select("vec_id", vectors.encode_f16("embedding").alias("raw"))
    return v.select("vec_id", F.octet_length("raw").alias("n_bytes"), vectors.decode_f16("raw").alias("embedding"))


def meaning_search(spark, sf_dir, limit: int = 5):
    """Twice the limit by cosine, the best of each page (label), cut to the limit, with a name."""
    e = read(spark, sf_dir, "embeddings")
    top = vectors.topk(e.filter("vec_id % 50 = 0"), e, 2 * limit).join(e.select("vec_id", "label"), "vec_id")
    best = top.withColumn("nth", F.row_number().over(Window.partitionBy("query", "label").orderBy("rank"))).filter("nth = 1")
    cut = best.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).filter(F.col("place") <= limit)
    who = read(spark, sf_dir, "supplier").select((F.col("s_suppkey") - 1).alias("label"), "s_name")
    return cut.join(who, "label", "left").select("query", "vec_id", "place", "s_name")


def overlap_score(spark, sf_dir, n: int = 5):
    """Of each item, the share of its different word n-grams that a document holds."""

    def grams(df, key):
        def of(w):
            g = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
            return F.when(F.size(w) >= n, F.array_distinct(g))

        return df.select(key, T.once(T.tokens(F.lower("text")), of).alias("g")).filter("g IS NOT NULL")

    items = grams(read(spark, sf_dir, "benchmark"), "item_id").select("item_id", F.size("g").alias("of"), F.explode("g").alias("gram"))
    docs = grams(read(spark, sf_dir, "documents"), "doc_id").select("doc_id", F.explode("g").alias("gram"))
    return docs.join(items, "gram").groupBy("doc_id", "item_id").agg(F.round(F.count("*") / F.first("of"), 9).alias("score"))


def located(spark, sf_dir):
    d = read(spark, sf_dir, "documents")
    return search.locate(d, "of the")


QUERIES = {
    "src_decode": src_decode, "parse_header": parse_header, "parse_body": parse_body, "import_log": import_log, "src_book_json": src_book_json, "paginate": paginate, "book_issues": book_issues,
    "vec_decode_f16": vec_decode_f16, "meaning_search": meaning_search, "overlap_score": overlap_score, "snippet_locate": located,
    "lang_strip": lambda spark, d: read(spark, d, "part").select("p_partkey", *[c.alias(a) for c, a in zip(names.lang_strip(F.concat("p_name", F.lit(" ، عربي"))), ("clean", "hint"), strict=True)]),
    "honorific_spell": lambda spark, d: read(spark, d, "documents").select("doc_id", F.md5(names.honorific_spell(F.col("text"))).alias("text_md5")),
}

SQL = {
    "src_decode": """SELECT doc_id AS book_id, md5('sum' || chr(10) || '< اسم الكتاب > ' || source || ' < / اسم الكتاب >' || chr(10) || '< طبعة > ' || lang || ' < / طبعة >' || chr(10) || '< الكتاب >' || chr(10) || '< صفحة > ' || doc_id % 7 || ' < / صفحة >' || chr(10)
      || coalesce(text, '') || chr(10) || CASE WHEN doc_id % 11 = 0 THEN '< هامش > open' ELSE '< / الكتاب >' END) AS text_md5 FROM documents""",
    "snippet_locate": r"""WITH d AS (SELECT doc_id, text, array_to_string(list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') AS line FROM documents)
      SELECT doc_id, CASE WHEN regexp_matches(text, '(?is)^((?:.*?[^\p{L}\p{N}_])??)of\s+the(?:$|[^\p{L}\p{N}_])') THEN length(regexp_extract(text, '(?is)^((?:.*?[^\p{L}\p{N}_])??)of\s+the(?:$|[^\p{L}\p{N}_])', 1)) END AS start FROM d WHERE contains(' ' || line || ' ', ' of the ')""",
    "parse_header": "SELECT doc_id AS book_id, source AS title, lang AS edition FROM documents WHERE doc_id % 11 <> 0",
    "import_log": "SELECT doc_id AS book_id, doc_id % 11 <> 0 AS ok, CASE WHEN doc_id % 11 = 0 THEN 'body' END AS stage FROM documents",
    "src_book_json": "SELECT conv_id, count(*) AS n_pages FROM conversations GROUP BY conv_id",
    "paginate": """SELECT conv_id, row_number() OVER w AS sequence, md5(role || chr(10) || coalesce(text, '')) AS text_md5, '0,' || (length(role) + 1) AS offsets,
      nullif(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0)::BIGINT AS section_ord
      FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)""",
    "book_issues": """SELECT conv_id, severity, code, n FROM (SELECT conv_id, 'warning' AS severity, 'missing_author' AS code, 1::BIGINT AS n FROM conversations GROUP BY conv_id
      UNION ALL SELECT conv_id, 'error', 'toc_heading_mismatch', count(*) FROM conversations WHERE role = 'user' GROUP BY conv_id
      UNION ALL SELECT conv_id, 'warning', 'empty_blocks', count(*) FROM conversations WHERE trim(coalesce(text, '')) = '' GROUP BY conv_id) t""",
    "meaning_search": """WITH s AS (SELECT q.vec_id AS query, v.vec_id, v.label, round(list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), 6) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0),
      t AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s), b AS (SELECT *, row_number() OVER (PARTITION BY query, label ORDER BY rank) AS nth FROM t WHERE rank <= 10),
      c AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY rank) AS place FROM b WHERE nth = 1) SELECT query, vec_id, place, s_name FROM c LEFT JOIN supplier ON s_suppkey - 1 = label WHERE place <= 5""",
    "overlap_score": r"""WITH b AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark), d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
      bg AS (SELECT DISTINCT item_id, array_to_string(w[i:i+4], ' ') AS gram FROM b, unnest(range(1, len(w) - 3)) AS r(i)), dg AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+4], ' ') AS gram FROM d, unnest(range(1, len(w) - 3)) AS r(i)),
      n AS (SELECT item_id, count(*) AS n FROM bg GROUP BY item_id) SELECT doc_id, item_id, round(count(*)::DOUBLE / any_value(n.n), 9) AS score FROM dg JOIN bg USING (gram) JOIN n USING (item_id) GROUP BY doc_id, item_id""",
    "lang_strip": "SELECT p_partkey, p_name AS clean, 'ar' AS hint FROM part",
}
