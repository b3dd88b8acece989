"""Checks and alignment of books: page lengths and numbers, labels, tables of contents, headings, coverage."""

from __future__ import annotations

import difflib
import functools
from bisect import bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .ranks import ranked
from .windows import around

# A long and a short page against the usual, findings of a check, main pages that a book must have, weight of
# footnotes; how far a number falls at a new block, lines of an ordered block; how far numbers may run ahead of pages.
LONG, SHORT, MOST, MAIN, FOOTNOTES = 1.8, 0.3, 40, 10, 0.6
RESTART, BLOCK, SKIP = 20, 5, 2
RATIO, OVERLAP, SHARED = 0.7, 0.6, 2


def page_checks(pages: DataFrame) -> DataFrame:
    """book, sequence, code: long and short pages, numbers that skip or fall back; at most MOST of a check for a book.

    pages: book, sequence, main (boolean), length (footnotes weighed), number (or null), heads (it begins with a heading),
    text (it has a text block). Lengths are checked in books of MAIN main pages or more.
    """
    by = Window.partitionBy("book").orderBy("sequence")
    upper = F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY l DESC)")
    usual = pages.filter("main AND length > 0").select("book", F.col("length").alias("l")).groupBy(F.col("book").alias("_b")).agg(upper.alias("usual"), F.count("*").alias("_main"))
    near = around("length", by, 5)
    own = pages.withColumn("_near", near).withColumn("_prev", F.lag("length").over(by)).withColumn("_next", F.lead("length").over(by)).withColumn("_next_heads", F.lead("heads").over(by))
    own = own.join(usual, F.col("book") == F.col("_b"))
    local = F.coalesce(F.get("_near", F.floor(F.size("_near") / 2).cast("int")), F.col("usual"))
    long = F.col("length") > F.greatest("usual", local) * LONG
    inside = (F.col("_prev") > 0) & (F.col("_next") > 0) & ~F.col("_next_heads") & ~F.col("heads") & F.col("text")
    code = F.when(long, "long-page").when((F.col("length") < F.col("usual") * SHORT) & inside, "short-page")
    lengths = own.filter((F.col("_main") >= MAIN) & F.col("main") & (F.col("length") > 0)).select("book", "sequence", code.alias("code"))
    found = lengths.filter("code IS NOT NULL").unionByName(jumps(pages).select("book", "sequence", "code"))
    kind = F.regexp_replace("code", "^number-.*", "number")
    nth = F.row_number().over(Window.partitionBy("book", kind).orderBy("sequence"))
    return found.withColumn("_nth", nth).filter(F.col("_nth") <= MOST).drop("_nth")


def jumps(pages: DataFrame) -> DataFrame:
    """book, sequence, prev, number, code: where the number of a main page does not follow the one before."""
    numbered = pages.filter("main AND number IS NOT NULL")
    prev = F.lag("number").over(Window.partitionBy("book").orderBy("sequence"))
    rows = numbered.select("book", "sequence", prev.alias("prev"), "number").filter(F.col("number") != F.col("prev") + 1)
    return rows.withColumn("code", F.when(F.col("number") <= F.col("prev"), "number-back").otherwise("number-skip"))


def page_numbers(pages: DataFrame) -> DataFrame:
    """book, sequence, type, number: front pages 0.1, 0.2 ...; then the printed number, or the sequence without one.

    The body begins at the first page whose printed number is less than one before it, as numbers start anew there.
    """
    by = Window.partitionBy("book").orderBy("sequence")
    top = F.max("printed").over(by.rowsBetween(Window.unboundedPreceding, -1))
    own = pages.withColumn("_falls", F.when(F.col("printed") < top, F.col("sequence")))
    split = F.min("_falls").over(Window.partitionBy("book"))
    own = own.withColumn("_front", F.coalesce(F.col("sequence") < split, F.lit(False)))
    number = F.when(F.col("_front"), F.concat(F.lit("0."), F.row_number().over(by).cast("string"))).otherwise(F.coalesce("printed", "sequence").cast("string"))
    return own.select("book", "sequence", F.when(F.col("_front"), "frontMatter").otherwise("main").alias("type"), number.alias("number"))


def summary(pages: DataFrame) -> DataFrame:
    """book, pages, main, front, blank, first, last: counts, and the least and greatest number of main pages that is a number."""
    n = F.when(F.col("type") == "main", F.col("number").try_cast("int"))
    count = lambda c: F.count_if(c)
    return pages.groupBy("book").agg(F.count("*").alias("pages"), count(F.col("type") == "main").alias("main"), count(F.col("type") == "frontMatter").alias("front"), count(F.coalesce("blank", F.lit(False))).alias("blank"), F.min(n).alias("first"), F.max(n).alias("last"))


def labels(pages: DataFrame) -> DataFrame:
    """book, sequence, label: the sequence less the offset of the latest anchor up to it, of the first one before all; without anchors the sequence.

    pages: book, sequence, anchor (the number printed there, or null).
    """
    by = Window.partitionBy("book").orderBy("sequence")
    offset = F.when(F.col("anchor").isNotNull(), F.col("sequence") - F.col("anchor"))
    own = pages.withColumn("_o", offset)
    latest = F.last("_o", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first("_o", ignorenulls=True).over(by.rowsBetween(0, Window.unboundedFollowing))
    return own.select("book", "sequence", (F.col("sequence") - F.coalesce(latest, first, F.lit(0))).alias("label"))


def keyed(found: DataFrame, known: DataFrame, key: list[str], id_col: str) -> DataFrame:
    """key and id of each different key of found: that of a known row with the same key, nulls included, else a new id past all.

    New keys are numbered in order, by ranges.
    """
    on = functools.reduce(lambda x, y: x & y, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in key])
    wanted = found.select(key).distinct()
    have = known.groupBy(key).agg(F.min(id_col).alias(id_col))
    old = wanted.alias("a").join(have.alias("b"), on).select(*[F.col(f"a.{k}") for k in key], F.col(f"b.{id_col}"))
    new = ranked(wanted.alias("a").join(have.alias("b"), on, "left_anti"), [F.col(k).asc_nulls_first() for k in key], "_n")
    top = F.broadcast(known.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top")))
    return old.unionByName(new.crossJoin(top).select(*key, (F.col("_top") + F.col("_n")).alias(id_col)))


def language(metadata: Column, title: Column, hint: Column) -> Column:
    """What the metadata say, else a mark in the title, else the collection's hint, else Arabic."""
    given = F.lower(F.trim(metadata))
    marked = F.when(title.rlike("فارس|\\bfa\\b"), "fa").when(title.rlike("انگلي|\\ben\\b"), "en")
    return F.coalesce(F.when(given != "", given), marked, hint, F.lit("ar"))


def coverage(source: Column, kept: Column) -> tuple[Column, Column]:
    """Letters of a source and of what was kept of it."""
    count = lambda c: F.regexp_count(F.coalesce(c, F.lit("")), F.lit(r"\p{L}"))
    return count(source), count(kept)


def contents_run(lines: DataFrame) -> DataFrame:
    """book, nth, number: the lines of a book's table of contents among numbered lines (book, nth, number).

    Lines are cut into blocks where the number falls by more than RESTART; a block of BLOCK lines is ordered. Blocks,
    a few for each book, are folded into runs; the run of widest span stays, without first lines above their next.
    """
    by = Window.partitionBy("book").orderBy("nth")
    falls = F.coalesce(F.col("number") < F.lag("number").over(by) - RESTART, F.lit(False)).cast("int")
    own = lines.withColumn("_falls", falls).withColumn("block", F.sum("_falls").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    blocks = own.groupBy("book", "block").agg(F.count("*").alias("n"), F.min_by("number", "nth").alias("head"), F.min("number").alias("lo"), F.max("number").alias("hi"))

    def widest(pdf: pd.DataFrame) -> pd.DataFrame:
        chosen = best_run([tuple(r) for r in pdf.sort_values("block")[["n", "head", "lo", "hi"]].itertuples(index=False)])
        return pd.DataFrame({"book": pdf["book"].iloc[:1], "first": [chosen[0]], "final": [chosen[1]]})

    runs = blocks.groupBy("book").applyInPandas(widest, "book string, first long, final long").withColumnRenamed("book", "_b")
    kept = own.join(runs, (F.col("book") == F.col("_b")) & F.col("block").between(F.col("first"), F.col("final")))
    # leading lines whose number is above the next one's go: all before the first that is not
    rises = F.coalesce(F.col("number") <= F.lead("number").over(by), F.lit(True))
    start = F.min(F.when(F.col("_rises"), F.col("nth"))).over(Window.partitionBy("book"))
    return kept.withColumn("_rises", rises).withColumn("_start", start).filter(F.col("nth") >= F.col("_start")).select("book", "nth", "number")


def best_run(blocks: list[tuple[int, int, int, int]]) -> tuple[int, int]:
    """(first, last) block of the widest run among blocks (n, head, lo, hi).

    A run begins and ends with an ordered block. It goes on with an ordered block that begins no lower than the run's
    lowest number, also over one short block between.
    """
    runs: list[list[int]] = []
    low = 0
    for k, (n, head, lo, _) in enumerate(blocks):
        if n < BLOCK:
            continue
        open_ = runs and k - runs[-1][-1] <= 2 and head >= low
        if open_:
            between = [blocks[i][2] for i in range(runs[-1][-1] + 1, k)]
            low = min(low, lo, *between)
            runs[-1].append(k)
        else:
            runs.append([k])
            low = lo

    def span(run: list[int]) -> tuple[int, int]:
        inside = blocks[run[0] : run[-1] + 1]
        return max(b[3] for b in inside) - min(b[2] for b in inside), sum(b[0] for b in inside)

    if not runs or not any(span(r) > (0, 0) for r in runs):
        return 0, len(blocks) - 1
    best = max(runs, key=span)
    return best[0], best[-1]


def without_outliers(anchors: DataFrame) -> DataFrame:
    """Anchors (book, sequence, number) without those whose offset differs from both neighbours, which agree with each other."""
    by = Window.partitionBy("book").orderBy("sequence", "number")
    own = anchors.withColumn("_o", F.col("sequence") - F.col("number"))
    lone = (F.lag("_o").over(by) == F.lead("_o").over(by)) & (F.col("_o") != F.lag("_o").over(by))
    return own.withColumn("_lone", F.coalesce(lone, F.lit(False))).filter("NOT _lone").drop("_o", "_lone")


def agreeing(anchors: list[tuple[int, int]], empty: list[int], skip: int = SKIP) -> list[tuple[int, int]]:
    """A largest set of anchors (sequence, number) that can all hold. empty: empty pages up to each sequence.

    From one to the next, neither falls, the file runs ahead of the numbers by empty pages between at most, and the numbers
    ahead of the file by skip at most.
    """

    def follows(a: tuple[int, int], b: tuple[int, int]) -> bool:
        pages, numbers = b[0] - a[0], b[1] - a[1]
        if pages <= 0 or numbers < 0:
            return pages == numbers == 0
        return numbers - skip <= pages <= numbers + empty[b[0] - 1] - empty[a[0]]

    # for each anchor the longest chain that ends with it: its length, the anchor, and the chain before it
    chains: list[tuple] = []
    for anchor in anchors:
        before = max((c for c in chains if follows(c[1], anchor)), key=lambda c: c[0], default=None)
        chains.append((1 + (before[0] if before else 0), anchor, before))
    longest, out = max(chains, key=lambda c: c[0], default=None), []
    while longest:
        out.insert(0, longest[1])
        longest = longest[2]
    return out


def steady(anchors: DataFrame, pages: DataFrame) -> DataFrame:
    """book, sequence, number: the anchors of each book that agree; pages: book, sequence, blank. A book is one task's work."""
    counts = pages.groupBy("book").agg(F.array_sort(F.collect_list(F.struct("sequence", F.coalesce("blank", F.lit(False)).alias("blank")))).alias("p"))
    own = without_outliers(anchors).groupBy("book").agg(F.array_sort(F.collect_list(F.struct("sequence", "number"))).alias("a")).join(counts, "book")

    def chosen(batches):
        for pdf in batches:
            out = []
            for book, a, p in zip(pdf["book"], pdf["a"], pdf["p"], strict=True):
                empty, blank = [0], {r["sequence"]: r["blank"] for r in p}
                for s in range(1, max([r["sequence"] for r in p] + [r["sequence"] for r in a]) + 1):
                    empty.append(empty[-1] + bool(blank.get(s)))
                out += [(book, s, n) for s, n in agreeing([(r["sequence"], r["number"]) for r in a], empty)]
            yield pd.DataFrame(out, columns=["book", "sequence", "number"])

    return own.mapInPandas(chosen, "book string, sequence long, number long")


def artifacts(anchors: DataFrame, pages: DataFrame) -> DataFrame:
    """book, sequence: empty pages that the numbering leaves out: between two anchors as many as the file runs ahead, the first ones."""
    by = Window.partitionBy("book").orderBy("sequence")
    gap = anchors.select(F.col("book").alias("_b"), F.col("sequence").alias("_lo"), F.lead("sequence").over(by).alias("_hi"), (F.lead("sequence").over(by) - F.lead("number").over(by) - F.col("sequence") + F.col("number")).alias("_extra")).filter("_extra > 0")
    blank = pages.filter("blank").join(gap, (F.col("book") == F.col("_b")) & (F.col("sequence") > F.col("_lo")) & (F.col("sequence") < F.col("_hi")))
    nth = F.row_number().over(Window.partitionBy("book", "_lo").orderBy("sequence"))
    return blank.withColumn("_nth", nth).filter(F.col("_nth") <= F.col("_extra")).select("book", "sequence")


def shared_words(a: Column, b: Column) -> tuple[Column, Column]:
    """(words that both have, their share of the fewer different words)."""
    x, y = F.array_distinct(a), F.array_distinct(b)
    both = F.size(F.array_intersect(x, y))
    return both, F.when((F.size(x) > 0) & (F.size(y) > 0), both / F.least(F.size(x), F.size(y))).otherwise(F.lit(0.0))


@F.pandas_udf(DoubleType())
def likeness(probe: pd.Series, text: pd.Series) -> pd.Series:
    """Ratio of the probe to the text's beginning of its length."""
    return pd.Series([difflib.SequenceMatcher(None, p or "", (t or "")[: len(p or "")]).ratio() for p, t in zip(probe, text, strict=True)], dtype="float64")


def fuzzy_headings(entries: DataFrame, lines: DataFrame) -> DataFrame:
    """book, entry, line, way: for entries of a contents (book, entry, key, words, expected) the line of the pages around that is meant.

    lines: book, line, page, key, words. By likeness of RATIO at least, on the page before to two after the expected one;
    else by words: SHARED of them and OVERLAP of the shorter, on the page before to the one after. Pages are the join's
    key, so an entry meets the lines of four pages and no others.
    """
    near = entries.withColumn("page", F.explode(F.sequence(F.greatest(F.col("expected") - 1, F.lit(1)), F.col("expected") + 2)))
    own = lines.select("book", "page", "line", F.col("key").alias("_key"), F.col("words").alias("_words"))
    both = near.join(own, ["book", "page"]).withColumn("ratio", likeness(F.col("key"), F.col("_key")))
    n, share = shared_words(F.col("words"), F.col("_words"))
    both = both.withColumn("_share", F.when((n >= SHARED) & (F.col("page") <= F.col("expected") + 1), share).otherwise(F.lit(0.0)))
    pick = lambda score: F.max(F.struct(F.round(score, 9).alias("s"), (-F.col("page")).alias("p"), (-F.col("line")).alias("l")))
    best = both.groupBy("book", "entry").agg(pick(F.col("ratio")).alias("a"), pick(F.col("_share")).alias("b"))
    way = F.when(F.col("a.s") >= RATIO, "likeness").when(F.col("b.s") >= OVERLAP, "words")
    line = F.when(F.col("a.s") >= RATIO, -F.col("a.l")).otherwise(-F.col("b.l"))
    return best.select("book", "entry", line.alias("line"), way.alias("way")).filter("way IS NOT NULL")


def located(place: int, chain: list[tuple[int, int]], a: list[str], b: list[str], gram: int = 4) -> tuple[int, bool]:
    """The place in b of a's word at place, and whether it is that word. chain: pairs of places that are known, rising in both.

    Only the words from the known pair before to the one after are compared.
    """
    k = bisect_right([x for x, _ in chain], place)
    lo = chain[k - 1] if k else (0, 0)
    hi = chain[k] if k < len(chain) else (len(a), len(b))
    left, right = a[lo[0] : hi[0] + gram], b[lo[1] : hi[1] + gram]
    at = place - lo[0]
    matched = difflib.SequenceMatcher(None, left, right, autojunk=False).get_matching_blocks()
    after = 0
    for x, y, n in matched:
        if x <= at < x + n:
            return lo[1] + y + at - x, True
        if x > at:
            break
        after = y + n
    return lo[1] + min(after, len(right)), False


def placed(books: DataFrame) -> DataFrame:
    """book, place, at, exact: the place of each word of a among those of b. books: book, a, b (word arrays), chain (pairs x, y).

    A book is one task's work; between two known places only the words between them are compared.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for book, a, b, chain in zip(pdf["book"], pdf["a"], pdf["b"], pdf["chain"], strict=True):
                known = sorted((c["x"], c["y"]) for c in chain)
                out += [(book, i, *located(i, known, list(a), list(b))) for i in range(len(a))]
            yield pd.DataFrame(out, columns=["book", "place", "at", "exact"])

    return books.select("book", "a", "b", "chain").mapInPandas(run, "book string, place long, at long, exact boolean")


def page_map(book: DataFrame, scan: DataFrame, n: int = 3) -> DataFrame:
    """page, scan_page, score: the scanned page that shares most n-grams with each page, moved into step with its neighbours.

    book and scan: page, words. Only n-grams that stand on one page of each side vote, so pages meet by those alone. A page
    whose offset differs from the median of the five votes before and after takes that, if its own score is under a half.
    """

    def grams(df: DataFrame, name: str) -> DataFrame:
        g = F.transform(F.sequence(F.lit(1), F.greatest(F.size("words") - n + 1, F.lit(1))), lambda i: F.array_join(F.slice("words", i, n), " "))
        each = df.select(F.col("page").alias(name), F.explode(F.array_distinct(g)).alias("gram"))
        return each.groupBy("gram").agg(F.min(name).alias(name), F.count("*").alias("_n")).filter("_n = 1").drop("_n")

    votes = grams(book, "page").join(grams(scan, "scan_page"), "gram").groupBy("page", "scan_page").agg(F.count("*").alias("n"))
    best = votes.groupBy("page").agg(F.max(F.struct("n", (-F.col("scan_page")).alias("s"))).alias("b"), F.sum("n").alias("all"))
    own = best.select("page", (-F.col("b.s")).alias("scan_page"), F.round(F.col("b.n") / F.col("all"), 9).alias("score")).withColumn("_o", -F.col("page") + F.col("scan_page"))
    own = own.withColumn("_part", F.floor(F.col("page") / 4096))
    near = around("_o", Window.partitionBy("_part").orderBy("page"), 5, zeros=True)
    step = F.coalesce(F.get(F.col("_near"), F.floor(F.size("_near") / 2).cast("int")), F.col("_o"))
    out = own.withColumn("_near", near)
    moved = (F.col("_o") != step) & (F.col("score") < 0.5)
    return out.select("page", F.when(moved, F.col("page") + step).otherwise(F.col("scan_page")).alias("scan_page"), "score")
