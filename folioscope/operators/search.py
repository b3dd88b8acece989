"""Search in pages and headings: index lines, phrases, order, snippets, results page by page; chunks and point ids."""

from __future__ import annotations

import re
import uuid
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import plain
from ..functions.text import DIGITS_FROM, DIGITS_TO, LETTERS_FROM, LETTERS_TO, MARKS, clean_marks, contains_words, index_line, normalize, once, phrase, prefix_all, tokens
from .ranks import first_page, with_total

#: Matches that are counted exactly, headings looked at, words and terms of a query, radius of a snippet.
EXACT, HEADINGS, WORDS, TERMS, RADIUS = 1000, 5000, 10, 8, 90
#: Fixed value: the rank weight of a word without a class.
WEIGHT = 0.1


def query_words(query: str | None, most: int = WORDS) -> list[str]:
    """The first words of a query, folded."""
    return plain(query or "").split()[:most]


def query_tokens(query: str | None) -> list[str]:
    return re.findall(r"[^\W_]+", plain(query or ""))


def heading_terms(query: str | None) -> list[str]:
    return query_tokens(query)[:TERMS]


def indexed(pages: DataFrame, text: str = "text") -> DataFrame:
    """pages with `line`, the folded words of the text between single spaces: what is stored for searching."""
    return pages.withColumn("line", index_line(F.col(text)))


def phrase_pages(index: DataFrame, query: str) -> DataFrame:
    """Pages whose words hold the query's words in a row; none for a query without words."""
    words = query_tokens(query)
    return index.filter(phrase(F.col("line"), words) if words else F.lit(False))


def all_word_pages(index: DataFrame, query: str) -> DataFrame:
    """Pages that hold every word, in any order."""
    words = query_tokens(query)
    return index.filter(contains_words(F.col("line"), words) if words else F.lit(False))


def occurrences(line: Column, query: str) -> Column:
    """How often the phrase stands in a line, those that share a word with the one before included."""
    words = query_tokens(query)
    own = F.array(*[F.lit(w) for w in words])
    places = lambda held: F.sequence(F.lit(1), F.greatest(F.size(held) - len(words) + 1, F.lit(1)))
    return once(F.split(F.trim(line), " "), lambda held: F.size(F.filter(places(held), lambda i: F.slice(held, i, len(words)) == own))).cast("long")


def score(line: Column, query: str) -> Column:
    """Cover density of a phrase: each occurrence is a cover without gaps, worth the weight of its words."""
    return F.round(occurrences(line, query) * F.lit(WEIGHT), 4)


def shown_total(n: Column, found: Column) -> Column:
    """Matches up to EXACT are counted; of more, the greater of EXACT and those found."""
    return F.when(n <= EXACT, n).otherwise(F.greatest(F.lit(EXACT), found)).cast("long")


def folded_pattern(query: str) -> str:
    """A pattern for the spellings that normalize to query: every original of a letter, marks after it, white space or marks between words."""
    spelled: dict[str, str] = {}
    for a, b in zip(LETTERS_FROM + DIGITS_FROM, LETTERS_TO + DIGITS_TO, strict=True):
        spelled[b] = spelled.get(b, "") + a
    letter = lambda c: f"[{c}{spelled[c]}]" if c in spelled else re.escape(c)
    words = [f"{MARKS}*".join(map(letter, w)) for w in query.split()]
    inside = r"[\p{L}\p{N}_]"
    return f"(?iu)(?<!{inside}{MARKS}{{0,2}})" + f"(?:\\s|{MARKS})+".join(words) + f"(?!{MARKS}{{0,2}}{inside})"


def match_place(text: Column, query: str) -> tuple[Column, Column]:
    """(start, end) of the first match in the text as written, in code points from 0; nulls without a match."""
    pattern = folded_pattern(plain(query))
    parts = F.split(text, pattern, 2)
    start = F.when(F.size(parts) > 1, F.length(parts[0]))
    return start, F.when(F.size(parts) > 1, F.length(text) - F.length(parts[1]))


def snippet(text: Column, query: str, radius: int = RADIUS) -> Column:
    """struct(snippet, start, end): the text around the first match, out to white space; places are within the snippet.

    Without a match, the first 2 x radius characters and nulls. All of it runs JVM-side.
    """
    start, end = match_place(text, query)
    ahead = F.regexp_replace(F.substring(text, F.lit(1), F.greatest(start - radius, F.lit(0))), r"(?U)\S+\z", "")
    lo = F.length(ahead)
    tail = F.substring(text, F.least(end + radius, F.length(text)) + 1, F.length(text))
    hi = F.least(end + radius, F.length(text)) + F.length(F.regexp_extract(tail, r"(?U)^\S*", 0))
    cut = F.substring(text, lo + 1, hi - lo)
    lead = F.length(cut) - F.length(F.regexp_replace(cut, r"(?U)^\s+", ""))
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+\z", "")
    found = F.struct(strip(cut).alias("snippet"), (start - lo - lead).cast("long").alias("start"), (end - lo - lead).cast("long").alias("end"))
    nothing = F.lit(None).cast("long")
    return F.when(start.isNotNull(), found).otherwise(F.struct(strip(F.substring(text, 1, 2 * radius)).alias("snippet"), nothing.alias("start"), nothing.alias("end")))


def snippets(docs: DataFrame, query: str, radius: int = RADIUS) -> DataFrame:
    """doc_id, snippet, start, end for the pages that hold the phrase."""
    hits = phrase_pages(indexed(docs.select("doc_id", "text")), query)
    return hits.select("doc_id", snippet(F.col("text"), query, radius).alias("s")).select("doc_id", "s.*")


def locate(docs: DataFrame, query: str) -> DataFrame:
    """doc_id, start: where the first match begins, in code points; null for pages that hold the phrase across punctuation."""
    hits = phrase_pages(indexed(docs.select("doc_id", "text")), query)
    return hits.select("doc_id", match_place(F.col("text"), query)[0].cast("long").alias("start"))


def chosen_books(books: DataFrame, subjects=None, libraries=None, languages=None, authors=None, works=None, added: bool = True) -> DataFrame:
    """books that the filters select. Works are added to what the other filters select, or (added false) one more filter.

    books: book, work_id, author_id, language, subjects and libraries (arrays).
    """
    own = F.lit(True)
    for values, test in ((subjects, lambda v: F.arrays_overlap("subjects", v)), (libraries, lambda v: F.arrays_overlap("libraries", v))):
        if values:
            own = own & test(F.array(*[F.lit(x) for x in values]))
    if languages:
        own = own & F.col("language").isin(*languages)
    if authors:
        own = own & F.col("author_id").isin(*authors)
    if works and not added:
        own = own & F.col("work_id").isin(*works)
    elif works:
        named = F.col("work_id").isin(*works)
        own = (own | named) if subjects or libraries or languages or authors else named
    return books.filter(own)


def search(pages: DataFrame, books: DataFrame, query: str, page: int = 1, limit: int = 50, index: DataFrame | None = None, **filters) -> DataFrame:
    """One page of hits: page_id, book, sequence, position, snippet, start, end, score, total, and the columns of books.

    pages: page_id, book, text; index: page_id, book, sequence, line, as stored (see indexed), or made from pages;
    books: book, rank and what chosen_books looks at. Hits are in order of the book's rank, then of the pages. Only ids are
    sorted and kept; texts are read for the hits shown, by a broadcast of at most page x limit ids.
    """
    hits = phrase_pages(indexed(pages) if index is None else index, query).select("page_id", "book", "sequence")
    hits = hits.join(chosen_books(books, **filters).select("book", "rank"), "book").select("page_id", "rank", "sequence").persist()
    order = [F.col("rank"), F.col("sequence"), F.col("page_id")]
    shown = with_total(first_page(hits, order, page, limit).select("page_id", "sequence", "position"), hits, "n")
    shown = shown.withColumn("total", shown_total(F.col("n"), F.least("n", F.lit(page * limit)))).drop("n")
    texts = pages.select("page_id", "book", "text").join(F.broadcast(shown), "page_id")
    out = indexed(texts).join(books, "book")
    return out.withColumn("score", score(F.col("line"), query)).withColumn("s", snippet(F.col("text"), query)).select("*", "s.*").drop("s", "line", "text")


def word_leg(index: DataFrame, keywords: list[str], each: int = 6) -> DataFrame:
    """doc_id, score: the first pages of each keyword, those in scope before others, fused by reciprocal rank.

    index: doc_id, line, scoped. Pages are read once for all keywords; a keyword keeps its first few, so little is shuffled.
    """
    asked = {k: query_tokens(k) for k in keywords}
    held = F.filter(F.array(*[F.when(phrase(F.col("line"), w), F.lit(k)) for k, w in asked.items() if w]), lambda x: x.isNotNull())
    hits = index.select("doc_id", "scoped", F.explode(held).alias("keyword"))
    nth = F.row_number().over(Window.partitionBy("keyword").orderBy(F.desc("scoped"), "doc_id"))
    return hits.withColumn("r", nth).filter(F.col("r") <= each).groupBy("doc_id").agg(F.round(F.sum(F.lit(1.0) / (60 + F.col("r"))), 12).alias("score"))


def headings(toc: DataFrame, query: str, labels: DataFrame, books: DataFrame, page: int = 1, limit: int = 50, cap: int = HEADINGS, **filters) -> DataFrame:
    """One page of headings: book, ord, heading, sequence, label, position, total, capped.

    toc: book, ord, heading, sequence; labels: book, sequence, label. Every term must begin some word of the heading. At
    most cap headings are looked at, the first by (book, ord), so that the same are taken each time; `capped` says so. All
    filters hold together here, that by works too.
    """
    terms = heading_terms(query)
    own = toc.withColumn("norm", normalize(F.col("heading"))).join(chosen_books(books, added=False, **filters).select("book"), "book", "left_semi")
    found = own.filter(prefix_all(tokens(F.col("norm")), terms) if terms else F.lit(False)).orderBy("book", "ord").limit(cap)
    whole = " ".join(query_words(query, 1 << 30))
    order = [F.when(F.col("norm") == whole, 0).otherwise(1), F.when(F.startswith(F.col("norm"), F.lit(whole)), 0).otherwise(1), F.length("norm"), F.col("book"), F.col("ord")]
    shown = with_total(first_page(found, order, page, limit), found)
    out = shown.join(labels.select("book", "sequence", "label"), ["book", "sequence"], "left")
    return out.select("book", "ord", "heading", "sequence", "label", "position", "total", (F.col("total") >= cap).alias("capped"))


def point_id(name: Column) -> Column:
    """The version 5 UUID of a name as a URL, by built-ins: the head of a SHA-1, with version and variant set."""
    h = F.sha1(F.concat(F.lit(uuid.NAMESPACE_URL.bytes), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab89ab89ab89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def point_ids(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", point_id(F.concat_ws(":", "source", F.col("doc_id").cast("string"), F.lit("0"))).alias("point_id"))


#: Words of a chunk, words repeated, words before a heading that end a chunk, and the least new words of one.
SIZE, OVERLAP, BREAK, LEAST = 220, 30, 80, 6
ENDS = (".", "؟", "!")


def chunk_words(blocks: list[tuple[str, list[str]]], size: int = SIZE, overlap: int = OVERLAP, heading: int = BREAK, least: int = LEAST) -> list[list[str]]:
    """Pieces of the words of (type, words) blocks.

    A piece ends at the last sentence end past 55 % of size, or at size; the next begins with its last sentence, or with
    its last `overlap` words. A heading begins a piece of its own if enough new words stand before it. A piece with fewer
    than `least` words that were not in one before is no piece.
    """
    words: list[str] = []
    breaks: set[int] = set()
    for kind, own in blocks:
        if own and kind in ("heading", "text"):
            if kind == "heading":
                breaks.add(len(words))
            words += own
    out: list[list[str]] = []
    begin = new = 0  # the piece's first word, and its first one that no piece before it had

    def close(end: int) -> None:
        if end - new >= least:
            out.append(words[begin:end])

    # places right after the ends of sentences
    sentences = [i for i, w in enumerate(words, 1) if w.endswith(ENDS)]

    def last_sentence(after: int, upto: int) -> int | None:
        k = bisect_right(sentences, upto)
        return sentences[k - 1] if k and sentences[k - 1] > after else None

    for stop in sorted({*breaks, len(words)}):
        # all words up to the next heading, or to the end, belong together
        while stop - begin > size:
            cut = last_sentence(begin + int(size * 0.55), begin + size) or begin + size
            close(cut)
            again = max(begin, cut - overlap)
            sentence = last_sentence(again, cut - 1)
            begin, new = sentence if sentence and cut - sentence >= 5 else again, cut
        if stop in breaks and stop - new >= heading:
            close(stop)
            begin = new = stop
    close(len(words))
    return out


def chunks(pages: DataFrame) -> DataFrame:
    """page_id, chunk, text, n_words, point_id for pages (page_id, book, sequence, blocks: array of (type, text)); blank pages have none.

    A page is cut by one task, as each piece depends on the one before.
    """

    def run(batches):
        for pdf in batches:
            rows = []
            for page_id, book, sequence, kinds, texts in zip(pdf["page_id"], pdf["book"], pdf["sequence"], pdf["kinds"], pdf["texts"], strict=True):
                for i, c in enumerate(chunk_words([(k, (t or "").split()) for k, t in zip(kinds, texts, strict=True)])):
                    rows.append((page_id, i, " ".join(c), len(c), str(uuid.uuid5(uuid.NAMESPACE_URL, f"{book}:{sequence}:{i}"))))
            yield pd.DataFrame(rows, columns=["page_id", "chunk", "text", "n_words", "point_id"])

    own = pages.select("page_id", "book", "sequence", F.coalesce("blocks", F.array().cast(pages.schema["blocks"].dataType)).alias("blocks"))
    own = own.select("page_id", "book", "sequence", F.col("blocks")["type"].alias("kinds"), F.transform("blocks", lambda b: clean_marks(b["text"])).alias("texts"))
    return own.mapInPandas(run, "page_id long, chunk long, text string, n_words long, point_id string")


def postings_phrase(postings: DataFrame, query: str) -> DataFrame:
    """doc_id, n: pages that hold the phrase, and how often, from an index of (term, doc_id, positions).

    A row for each query word is read; places, moved back by the word's number, meet by page.
    """
    words = query_tokens(query)
    wanted = {w: [i for i, x in enumerate(words) if x == w] for w in words}
    if not words:
        return postings.select("doc_id", F.lit(0).cast("long").alias("n")).limit(0)
    shifts = F.create_map(*[x for w, at in wanted.items() for x in (F.lit(w), F.array(*[F.lit(i) for i in at]))])
    own = postings.filter(F.col("term").isin(*wanted)).select("doc_id", F.transform(F.element_at(shifts, F.col("term")), lambda i: F.transform("positions", lambda p: p - i)).alias("starts"))
    # a start that every one of the phrase's words gives; a page's words are at most as many as its text has
    each = own.select("doc_id", F.explode("starts").alias("s")).groupBy("doc_id").agg(F.collect_list("s").alias("all"))
    both = F.aggregate(F.col("all"), F.col("all")[0], lambda a, b: F.array_intersect(a, b))
    return each.filter(F.size("all") == len(words)).select("doc_id", F.size(both).cast("long").alias("n")).filter("n > 0")


def matching_names(rows: DataFrame, name: str, column: str = "norm", most: int = 20, titles: list[str] | None = None) -> DataFrame:
    """Rows named `name`: those equal to it, else those that hold its core as whole words; none if more than most.

    A core of fewer than three letters matches nothing. Both ways are one aggregate of one row, so no match goes to the driver.
    """
    folded = plain(name)
    words = folded.split()
    while len(words) > 1 and words[0] in (titles or []):
        words = words[1:]
    bare = " ".join(words)
    if len(bare) < 3:
        return rows.withColumn("tier", F.lit(0)).limit(0)
    tier = F.when(F.col(column) == folded, 0).when(F.contains(F.concat(F.lit(" "), F.col(column), F.lit(" ")), F.lit(f" {bare} ")), 1)
    found = rows.withColumn("tier", tier).filter("tier IS NOT NULL")
    best = found.groupBy("tier").agg(F.count("*").alias("_n")).agg(F.min(F.struct("tier", "_n")).alias("_best"))
    return found.crossJoin(F.broadcast(best)).filter((F.col("tier") == F.col("_best.tier")) & (F.col("_best._n") <= most)).drop("_best")


def heard(pages: DataFrame) -> DataFrame:
    """book, sequence, prev, next, section: neighbours of each page and the heading as of it. pages: book, sequence, heading or null."""
    by = Window.partitionBy("book").orderBy("sequence")
    upto = by.rowsBetween(Window.unboundedPreceding, 0)
    return pages.select("book", "sequence", F.lag("sequence").over(by).alias("prev"), F.lead("sequence").over(by).alias("next"), F.last("heading", ignorenulls=True).over(upto).alias("section"))
