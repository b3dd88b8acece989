"""Catalog and text questions: literal search, names, corpus counts, samples, retrieval lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ranks import first_page

#: Queries, keywords, authors and books that a rewrite may give; hits that a scope must have.
QUERIES, KEYWORDS, PEOPLE, WORKS, ENOUGH = 3, 3, 2, 2, 3
#: Fixed value: the constant of reciprocal rank fusion.
RRF = 60


def holds(column: Column, text: str) -> Column:
    """Whether a text stands in a column as it is; % and _ mean themselves."""
    return F.contains(column, F.lit(text))


def titled(works: DataFrame, authors: DataFrame, books: DataFrame, words: list[str]) -> DataFrame:
    """work_id of works in which every word stands in the title, the author's name or a published volume's title.

    works: work_id, author_id, title; authors: author_id, name; books: work_id, title, published. All are folded. One
    haystack is made for each work, so the number of words does not matter.
    """
    volumes = books.filter("published").groupBy("work_id").agg(F.array_join(F.collect_set("title"), "\n").alias("_volumes"))
    whole = works.join(authors.select("author_id", "name"), "author_id", "left").join(volumes, "work_id", "left")
    hay = whole.select("work_id", F.concat_ws("\n", "title", "name", "_volumes").alias("h"))
    test = F.lit(bool(words))
    for w in words:
        test = test & holds(F.col("h"), w)
    return hay.filter(test).select("work_id")


def survey(works: DataFrame, fields: list[str], title: str, author: str, size: str, top: int = 5) -> DataFrame:
    """metric, value: how many have each field, different (title, author), the share of those with several, and the largest."""
    filled = [F.count_if(F.col(f).isNotNull() & (F.col(f).cast("string") != "")) / F.count("*") for f in fields]
    one = works.agg(F.count("*").cast("double").alias("n"), *[c.alias(f"fill {f}") for f, c in zip(fields, filled, strict=True)])
    pairs = works.groupBy(title, author).agg(F.count("*").alias("_n")).agg(F.count("*").cast("double").alias("different"), (F.count_if(F.col("_n") > 1) / F.count("*")).alias("several"))
    flat = lambda df: df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.round(F.col(f"`{c}`"), 9).alias("value")) for c in df.columns])))
    largest = works.orderBy(F.desc(size), title).limit(top)
    nth = F.row_number().over(Window.orderBy(F.desc(size), title))
    return flat(one).unionByName(flat(pairs)).unionByName(largest.select(F.concat(F.lit("largest "), nth.cast("string")).alias("metric"), F.col(size).cast("double").alias("value")))


def mode_and_median(rows: DataFrame, by: str, value: str) -> DataFrame:
    """The most common value (the least of several) and the upper median of each group."""
    return rows.groupBy(by).agg(F.mode(value, True).alias("mode"), F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value} DESC)").alias("median"))


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of all words."""
    return docs.select(F.explode(T.tokens(F.lower("text"))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def chance(key: Column, seed: int) -> Column:
    """A number from 0 to 1 that a key and a seed give, the same on every engine that has MD5."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", key, F.lit(str(seed)))), 1, 12), 16, 10).cast("double") + 1) / float(1 << 48)


def sampled(rows: DataFrame, key: str, k: int, seed: int, weight: str | None = None) -> DataFrame:
    """k rows without replacement, all equally likely or by weight: the greatest keys ln(u) / weight stay. Tasks keep k rows each."""
    u = chance(F.col(key), seed)
    return rows.orderBy(F.desc(F.ln(u) / F.col(weight) if weight else u), key).limit(k)


def phrases(docs: DataFrame, n: int, k: int, seed: int) -> DataFrame:
    """doc_id, phrase: n words in a row from a place that chance gives, in k documents that chance gives."""
    own = docs.select("doc_id", T.tokens(F.lower("text")).alias("w")).filter(F.size("w") >= n)
    at = F.floor(chance(F.col("doc_id").cast("string"), seed + 1) * (F.size("w") - n)).cast("int") + 1
    return sampled(own.select("doc_id", F.array_join(F.slice("w", at, n), " ").alias("phrase")), "doc_id", k, seed)


def document_shares(docs: DataFrame, least: float = 0.0, most: float = 1.0) -> DataFrame:
    """word, df, share: words by the share of documents that hold them. A document's words are made different before they are dealt."""
    df = docs.select(F.explode(F.array_distinct(T.tokens(F.lower("text")))).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    out = df.crossJoin(F.broadcast(docs.agg(F.count("*").alias("_n")))).withColumn("share", F.col("df") / F.col("_n"))
    return out.filter((F.col("share") >= least) & (F.col("share") <= most)).select("word", "df", F.round("share", 9).alias("share"))


def classified(text: Column, rules: list[tuple[str, str]], unsure: str) -> tuple[Column, Column]:
    """(class, review): the first rule (pattern, class) that matches; what `unsure` matches is other, the rest misc, both to be reviewed."""
    out = F.when(text.rlike(unsure), "other")
    for pattern, name in reversed(rules):
        out = F.when(text.rlike(pattern), name).otherwise(out)
    known = F.lit(False)
    for pattern, _ in rules:
        known = known | text.rlike(pattern)
    return F.coalesce(out, F.lit("misc")), ~known


def iso(text: Column) -> Column:
    """An ISO 8601 time as UTC with milliseconds and Z; times without zone are UTC; what is no time is null."""
    zoned = text.rlike(r"(?i)[0-9:.](z|[+-][0-9]{2}:[0-9]{2})$") & F.contains(text, F.lit(":"))
    whole = F.when(F.length(text) == 10, F.concat(text, F.lit("T00:00:00"))).otherwise(text)
    at = F.try_to_timestamp(F.when(zoned, text).otherwise(F.concat(whole, F.lit("Z"))))
    return F.date_format(F.to_utc_timestamp(at, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def redacted(line: Column) -> Column:
    """A log line without what was searched for."""
    return F.regexp_replace(line, r"([?&]q=)[^&\s\"]*", "$1-")


def inside(path: Column, root: str) -> Column:
    """Whether a relative path stays under its root: none that is absolute, and none that climbs above it at any step."""
    depth = F.aggregate(F.split(path, "/"), F.struct(F.lit(0).alias("at"), F.lit(0).alias("low")), lambda a, p: F.struct((a["at"] + F.when(p == "..", -1).when(p.isin("", "."), 0).otherwise(1)).alias("at"), F.least(a["low"], a["at"] + F.when(p == "..", -1).otherwise(0)).alias("low")))
    return F.coalesce(~F.startswith(path, F.lit("/")) & ~F.contains(path, F.lit("\0")) & (depth["low"] >= 0) & F.lit(bool(root)), F.lit(False))


def fused(lists: list[DataFrame], key: list[str]) -> DataFrame:
    """key, score of reciprocal ranks over lists (key, rank from 0)."""
    both = lists[0].select(*key, "rank")
    for x in lists[1:]:
        both = both.unionByName(x.select(*key, "rank"))
    return both.groupBy(*key).agg(F.round(F.sum(F.lit(1.0) / (RRF + 1 + F.col("rank"))), 12).alias("score"))


def merged_candidates(meaning: DataFrame, words: DataFrame) -> DataFrame:
    """book, sequence, text, score, place: two lists (book, sequence, rank, text) fused; of equal signatures the best stays, empty ones all do.

    A page in both has the text of the first.
    """
    key = ["book", "sequence"]
    texts = meaning.select(*key, "text", F.lit(0).alias("_from")).unionByName(words.select(*key, "text", F.lit(1).alias("_from"))).groupBy(*key).agg(F.min_by("text", "_from").alias("text"))
    own = fused([meaning, words], key).join(texts, key).withColumn("_sig", T.signature(T.normalize(F.col("text"))))
    order = [F.desc("score"), F.col("book"), F.col("sequence")]
    first = F.row_number().over(Window.partitionBy("_sig").orderBy(*order))
    kept = own.withColumn("_nth", first).filter("_nth = 1 OR _sig = ''")
    # candidates are two short lists
    return kept.select(*key, "text", "score", F.row_number().over(Window.orderBy(*order)).alias("place"))


def reranked(answers: DataFrame, top: int) -> DataFrame:
    """ask, picks: indexes that a model gave (array), from 1 to n, without others and repeats, top at most; the merged order if none is left."""
    good = F.slice(F.array_distinct(F.filter("picks", lambda i: i.between(1, F.col("n")))), 1, top)
    return answers.select("ask", F.when(F.size(good) > 0, good).otherwise(F.slice(F.sequence(F.lit(1), F.greatest("n", F.lit(1))), 1, F.least("n", F.lit(top)))).alias("picks"))


def strings(value: Column, most: int) -> Column:
    """The strings of a JSON array, most at most; other values are dropped, what is no array has none."""
    items = F.from_json(value, "array<variant>")
    own = F.filter(items, lambda x: F.schema_of_variant(x) == "STRING")
    return F.coalesce(F.slice(F.transform(own, lambda x: F.variant_get(x, "$", "string")), 1, most), F.array().cast("array<string>"))


def rewritten(answers: DataFrame) -> DataFrame:
    """ask, queries, keywords, authors, books from a model's JSON answer."""
    part = lambda name, most: strings(F.get_json_object("answer", f"$.{name}"), most).alias(name)
    return answers.select("ask", part("queries", QUERIES), part("keywords", KEYWORDS), part("authors", PEOPLE), part("books", WORKS))


def query_set(question: Column, queries: Column) -> Column:
    """The question and its rewritings, each once, in order."""
    return F.array_distinct(F.concat(F.array(question), F.coalesce(queries, F.array().cast("array<string>"))))


def scoped(hits: DataFrame, scope: DataFrame, column: str, enough: int = ENOUGH) -> DataFrame:
    """hits within a scope, or all of them if there are fewer than enough within it; an empty scope is the whole library."""
    own = hits.join(scope.select(F.col(scope.columns[0]).alias("_s")).distinct(), F.col(column) == F.col("_s"), "left").withColumn("_in", F.col("_s").isNotNull()).drop("_s")
    few = F.broadcast(own.agg((F.count_if("_in") < enough).alias("_few")))
    return own.crossJoin(few).filter("_few OR _in").drop("_few", "_in")


def envelope(rows: DataFrame, order: list[Column], page: int, limit: int) -> DataFrame:
    """One row: a page of rows as an array of structs, with total, page, limit and whether more follow."""
    items = first_page(rows, order, page, limit, "_n").agg(F.array_sort(F.collect_list(F.struct("_n", *rows.columns))).alias("i"))
    items = items.select(F.transform("i", lambda x: F.struct(*[x[c].alias(c) for c in rows.columns])).alias("items"))
    return items.crossJoin(rows.agg(F.count("*").alias("total"))).select("items", "total", F.lit(page).alias("page"), F.lit(limit).alias("limit"), (F.col("total") > page * limit).alias("has_more"))
