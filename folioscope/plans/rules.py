"""Queries on the operators for catalogs, records, limits and editing, and SQL that was written apart from them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import names
from ..functions import text as T
from ..operators import catalog as C
from ..operators import editing as E
from ..operators import records as R
from ..operators import postings, search, windows
from ..operators.ranks import first_page, numbered
from ..sources.tables import read
from . import find, shelves
from .find import norm_sql, quoted

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) by its name, with its SQL."""

    def of(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return of


def _us(column: str = "ts"):
    return F.unix_micros(F.col(column).cast("timestamp"))


# Filters and the catalog

MARKED = "p_name || CASE p_partkey % 3 WHEN 0 THEN ' 10%' WHEN 1 THEN ' a_b' ELSE ' 10x' END"


@query(f"SELECT p_partkey, t LIKE '%10!%%' ESCAPE '!' AS percent, t LIKE '%a!_b%' ESCAPE '!' AS underscore FROM (SELECT p_partkey, {MARKED} AS t FROM part) x WHERE t LIKE '%10!%%' ESCAPE '!' OR t LIKE '%a!_b%' ESCAPE '!'")
def contains_literal(spark, d):
    k = F.col("p_partkey") % 3
    t = F.concat("p_name", F.when(k == 0, " 10%").when(k == 1, " a_b").otherwise(" 10x"))
    p = read(spark, d, "part").select("p_partkey", C.holds(t, "10%").alias("percent"), C.holds(t, "a_b").alias("underscore"))
    return p.filter("percent OR underscore")


NAMES = ("Supplier 000000007", "Dr 00000003", "000000004", "supplier", "ab")


@query(f"""WITH a AS (SELECT s_suppkey, lower(replace(s_name, '#', ' ')) AS norm FROM supplier), q AS (SELECT * FROM (VALUES ('Supplier 000000007', 'supplier 000000007'), ('Dr 00000003', '00000003'), ('000000004', '000000004'), ('supplier', 'supplier')) v(asked, bare)),
m AS (SELECT asked, s_suppkey, CASE WHEN norm = lower(asked) THEN 0 ELSE 1 END AS tier FROM q JOIN a ON norm = lower(asked) OR contains(' ' || norm || ' ', ' ' || bare || ' ')),
b AS (SELECT *, min(tier) OVER (PARTITION BY asked) AS best FROM m), c AS (SELECT *, count(*) OVER (PARTITION BY asked) AS n FROM b WHERE tier = best) SELECT asked, s_suppkey, tier FROM c WHERE n <= 4""")
def match_unambiguous(spark, d):
    a = read(spark, d, "supplier").select("s_suppkey", F.lower(F.replace("s_name", F.lit("#"), F.lit(" "))).alias("norm"))
    out = None
    for name in NAMES:
        found = search.matching_names(a, name, most=4, titles=["dr"]).select(F.lit(name).alias("asked"), "s_suppkey", "tier")
        out = found if out is None else out.unionByName(found)
    return out


@query("""WITH b AS (SELECT l_partkey AS w, min(l_suppkey) AS a FROM lineitem GROUP BY l_partkey),
v AS (SELECT l_partkey AS w, 'volume ' || l_linenumber || lower(l_linestatus) AS t FROM lineitem WHERE l_returnflag <> 'R'), x AS (SELECT p_partkey AS work_id, lower(p_name) AS t, lower(s_name) AS s FROM part LEFT JOIN b ON w = p_partkey LEFT JOIN supplier ON s_suppkey = a)
SELECT work_id FROM x WHERE (contains(t, '1') OR contains(coalesce(s, ''), '1') OR EXISTS (SELECT 1 FROM v WHERE w = work_id AND contains(v.t, '1')))
  AND (contains(t, '7o') OR contains(coalesce(s, ''), '7o') OR EXISTS (SELECT 1 FROM v WHERE w = work_id AND contains(v.t, '7o')))""")
def title_author_search(spark, d):
    line = read(spark, d, "lineitem")
    first = line.groupBy("l_partkey").agg(F.min("l_suppkey").alias("author_id"))
    works = read(spark, d, "part").join(first, F.col("p_partkey") == F.col("l_partkey"), "left").select(F.col("p_partkey").alias("work_id"), "author_id", F.lower("p_name").alias("title"))
    authors = read(spark, d, "supplier").select(F.col("s_suppkey").alias("author_id"), F.lower("s_name").alias("name"))
    books = line.select(F.col("l_partkey").alias("work_id"), F.concat(F.lit("volume "), F.col("l_linenumber").cast("string"), F.lower("l_linestatus")).alias("title"), (F.col("l_returnflag") != "R").alias("published"))
    return C.titled(works, authors, books, search.query_words("1 7O"))


PAGE = "SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS sequence, doc_id, lang, text, n_chars FROM documents"


def _pages(spark, d, *columns):
    """book, sequence, doc_id and columns of documents; numbers come from ids alone."""
    own = read(spark, d, "documents")
    return numbered(own.select(F.col("source").alias("book"), "doc_id", *columns), "book", "doc_id")


@query(f"WITH p AS ({PAGE}), h AS (SELECT book, sequence, CASE WHEN doc_id % 7 = 0 THEN 'h' || doc_id END AS heading FROM p) SELECT p.book, p.sequence, (SELECT max(q.sequence) FROM p q WHERE q.book = p.book AND q.sequence < p.sequence) AS prev, (SELECT min(q.sequence) FROM p q WHERE q.book = p.book AND q.sequence > p.sequence) AS next, (SELECT arg_max(heading, h.sequence) FROM h WHERE h.book = p.book AND h.sequence <= p.sequence AND heading IS NOT NULL) AS section FROM p")
def page_neighbors(spark, d):
    heading = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("h"), F.col("doc_id").cast("string")))
    return search.heard(_pages(spark, d).withColumn("heading", heading))


@query(f"WITH {find.TOC_SQL} SELECT t.book, ord, heading, CASE WHEN page_id IS NULL THEN CAST(sequence AS VARCHAR) ELSE 'p. ' || page_id END AS page FROM t LEFT JOIN pages ON CAST(page_id % 10 AS VARCHAR) = t.book AND page_id * 2 = sequence AND page_id % 3 > 0 WHERE heading <> ''")
def reader_toc(spark, d):
    t = find.toc(spark, d).join(find._labels(spark, d), ["book", "sequence"], "left")
    return t.select("book", "ord", "heading", F.coalesce("label", F.col("sequence").cast("string")).alias("page"))


@query("""WITH w AS (SELECT p_partkey, CASE WHEN p_partkey % 4 > 0 THEN p_name ELSE '' END AS title, CASE WHEN p_partkey % 5 > 0 THEN p_brand END AS author, p_retailprice AS size, p_type FROM part), g AS (SELECT count(*) AS n FROM w GROUP BY title, author)
SELECT 'n' AS metric, count(*)::DOUBLE AS value FROM w UNION ALL SELECT 'fill title', round(avg((title <> '')::INT), 9) FROM w UNION ALL SELECT 'fill author', round(count(author) / count(*), 9) FROM w UNION ALL SELECT 'fill p_type', 1.0::DOUBLE
UNION ALL SELECT 'different', count(*)::DOUBLE FROM g UNION ALL SELECT 'several', round(avg((n > 1)::INT), 9) FROM g
UNION ALL SELECT 'largest ' || row_number() OVER (ORDER BY size DESC, title), size FROM (SELECT * FROM w ORDER BY size DESC, title LIMIT 5) t""")
def survey_fill_rates(spark, d):
    k = F.col("p_partkey")
    w = read(spark, d, "part").select(F.when(k % 4 > 0, F.col("p_name")).otherwise("").alias("title"), F.when(k % 5 > 0, F.col("p_brand")).alias("author"), F.col("p_retailprice").alias("size"), "p_type")
    return C.survey(w, ["title", "author", "p_type"], "title", "author", "size")


@query("""WITH c AS (SELECT source, n_chars % 50 AS v, count(*) AS n FROM documents GROUP BY ALL), m AS (SELECT source, arg_min(v, (-n, v)) AS mode FROM c GROUP BY source)
SELECT source, mode, median FROM m JOIN (SELECT source, list_sort(list(n_chars % 50))[len(list(n_chars)) // 2 + 1] AS median FROM documents GROUP BY source) USING (source)""")
def mode_median(spark, d):
    return C.mode_and_median(read(spark, d, "documents").select("source", (F.col("n_chars") % 50).alias("v")), "source", "v")


WORDS = r"list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
U = "(CAST('0x' || left(md5({key} || '|{seed}'), 12) AS BIGINT) + 1) / 281474976710656.0"


@query(f"SELECT word, count(*) AS n FROM (SELECT unnest({WORDS}) AS word FROM documents) t GROUP BY word")
def word_freq(spark, d):
    return C.word_counts(read(spark, d, "documents"))


@query(f"WITH c AS (SELECT word, count(*) AS n FROM (SELECT unnest({WORDS}) AS word FROM documents) t GROUP BY word) SELECT * FROM (SELECT word, 'weighted' AS way FROM c ORDER BY ln({U.format(key='word', seed=3)}::DOUBLE) / n DESC, word LIMIT 40) a UNION ALL SELECT * FROM (SELECT word, 'uniform' FROM c ORDER BY {U.format(key='word', seed=3)}::DOUBLE DESC, word LIMIT 40) b")
def word_sample(spark, d):
    c = C.word_counts(read(spark, d, "documents"))
    return C.sampled(c, "word", 40, 3, "n").select("word", F.lit("weighted").alias("way")).unionByName(C.sampled(c, "word", 40, 3).select("word", F.lit("uniform").alias("way")))


@query(f"""WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents), p AS (SELECT *, floor({U.format(key='doc_id', seed=6)}::DOUBLE * (len(w) - 3))::INT + 1 AS a FROM d WHERE len(w) >= 3)
SELECT doc_id, w[a] || ' ' || w[a + 1] || ' ' || w[a + 2] AS phrase FROM p ORDER BY {U.format(key='doc_id', seed=5)}::DOUBLE DESC, doc_id LIMIT 60""")
def phrase_sample(spark, d):
    return C.phrases(read(spark, d, "documents"), 3, 60, 5)


_SHARES = f"WITH c AS (SELECT word, count(DISTINCT doc_id) AS df FROM (SELECT doc_id, unnest({WORDS}) AS word FROM documents) t GROUP BY word) SELECT word, df, round(df / (SELECT count(*) FROM documents)::DOUBLE, 9) AS share FROM c WHERE df / (SELECT count(*) FROM documents)::DOUBLE"


@query(f"{_SHARES} >= 0.02")
def common_words(spark, d):
    return C.document_shares(read(spark, d, "documents"), least=0.02)


@query(f"{_SHARES} < 0.02")
def rare_keyword(spark, d):
    return C.document_shares(read(spark, d, "documents"), most=0.02).filter("share < 0.02")


_INDEX = f"w AS (SELECT doc_id, list_filter(string_split_regex({norm_sql('text')}, '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents), t AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS i FROM w)"


@query(f"WITH {_INDEX} SELECT term, doc_id, string_agg(i::VARCHAR, ',' ORDER BY i) AS positions FROM t GROUP BY term, doc_id")
def tokenize_index(spark, d):
    return _joined(postings.postings(postings.page_index(read(spark, d, "documents"))))


@query(f"WITH {_INDEX} SELECT translate(term, 'éèê', 'eee') AS term, doc_id, string_agg(i::VARCHAR, ',' ORDER BY i) AS positions FROM t GROUP BY translate(term, 'éèê', 'eee'), doc_id")
def postings_fold(spark, d):
    return _joined(postings.postings(postings.fold_index(postings.page_index(read(spark, d, "documents")))))


def _joined(index):
    return index.withColumn("positions", F.array_join(F.transform("positions", lambda x: x.cast("string")), ","))


# Text

LABELS = ("١٢ هـ", "سنة ٤٠٠", "12 b 7", "b 7", "x", "", "۱۴۰۲", "7 ", " 9x3", "300-310")
HONOURED = ("الشيخ المفيد", "السيد الشيخ محمد باقر", "الشيخ", "العلامة الحلي", "محمد الشيخ", "آية الله")
VERSES = ("الْعِلْمُ   نُـــورٌ", "قَالَ\tرَبِّ", "  plain  text ", "")


def _strings(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "i int, t string")


def _values(values):
    return "(VALUES " + ", ".join(f"({i}, {quoted(x)})" for i, x in enumerate(values)) + ") v(i, t)"


_DIGITS = f"translate(t, {quoted(T.DIGITS_FROM)}, {quoted(T.DIGITS_TO)})"


@query(f"SELECT i, trim(regexp_replace(regexp_replace(t, '[ؐ-ًؚ-ٰٟۖ-ۭـ]', '', 'g'), '\\s+', ' ', 'g')) AS t FROM (SELECT * FROM {_values(VERSES)} UNION ALL SELECT doc_id + 10, text FROM documents) x")
def clean_marks(spark, d):
    both = _strings(spark, VERSES).unionByName(read(spark, d, "documents").select((F.col("doc_id") + 10).alias("i"), F.col("text").alias("t")))
    return both.select("i", T.clean_marks(F.col("t")).alias("t"))


@query(f"SELECT i, try_cast(regexp_extract({_DIGITS}, '[0-9]+') AS INT) AS n FROM {_values(LABELS)}")
def first_int(spark, d):
    return _strings(spark, LABELS).select("i", T.first_int(F.col("t")).alias("n"))


@query(f"SELECT i, coalesce(try_cast(regexp_extract({_DIGITS}, '^\\s*([0-9]+)', 1) AS INT), try_cast(regexp_extract({_DIGITS}, '([0-9]+)\\s*$', 1) AS INT)) AS n FROM {_values(LABELS)}")
def printed_number(spark, d):
    return _strings(spark, LABELS).select("i", T.printed_number(F.col("t")).alias("n"))


@query("WITH t AS (SELECT conv_id, turn, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM conversations) SELECT conv_id, turn, CASE WHEN length(t) > 60 THEN rtrim(left(t, 59)) || '…' ELSE t END AS title FROM t")
def title_of(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", T.title_of(F.col("text")).alias("title"))


@query(f"SELECT * FROM (VALUES (0, 'المفيد'), (1, 'محمد باقر'), (2, 'الشيخ'), (3, 'الحلي'), (4, 'محمد الشيخ'), (5, 'ايه الله')) v(i, core) UNION ALL SELECT c_custkey + 10, lower(c_name) FROM customer")
def name_core(spark, d):
    titles = [names.plain(t) for t in names.TITLES]
    both = _strings(spark, HONOURED).unionByName(read(spark, d, "customer").select((F.col("c_custkey") + 10).alias("i"), F.concat(F.lit("الشيخ "), "c_name").alias("t")))
    return both.select("i", T.name_core(T.normalize(F.col("t")), titles).alias("core"))


@query(r"""WITH w AS (SELECT conv_id, turn, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM conversations), f AS (SELECT *, list_transform(w, lambda x: regexp_replace(lower(x), '[^\p{L}\p{N}_]', '', 'g')) AS f FROM w)
SELECT conv_id, turn, array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT coalesce(f[i] = 'the' OR (f[i] = 'of' AND f[i + 1] = 'the'), false)), lambda i: w[i]), ' ') AS rest FROM f""")
def strip_names(spark, d):
    return read(spark, d, "conversations").select("conv_id", "turn", names.strip_names(F.col("text"), ["of the", "The"]).alias("rest"))


MAILS = (" Jane@Example.COM ", "a@b", "a b@c.de", "@c.de", "x@y.z.", "ok.name+tag@sub.domain.org", "two@@at.org", "")


@query(f"SELECT i, lower(trim(t)) AS email, regexp_full_match(lower(trim(t)), '[^@\\s]+@[^@\\s.]+(\\.[^@\\s.]+)+') AND length(trim(t)) <= 254 AS valid FROM {_values(MAILS)}")
def email_norm(spark, d):
    return _strings(spark, MAILS).select("i", T.email_norm(F.col("t")).alias("email"), T.email_valid(F.col("t")).alias("valid"))


RULES = [("^STANDARD", "plain"), ("^(PROMO|ECONOMY)", "offer"), ("BRASS$", "metal"), ("TIN$", "metal")]


@query("SELECT p_partkey, CASE WHEN p_type LIKE 'STANDARD%' THEN 'plain' WHEN p_type LIKE 'PROMO%' OR p_type LIKE 'ECONOMY%' THEN 'offer' WHEN p_type LIKE '%BRASS' OR p_type LIKE '%TIN' THEN 'metal' WHEN p_type LIKE '%STEEL%' THEN 'other' ELSE 'misc' END AS class, NOT (p_type LIKE 'STANDARD%' OR p_type LIKE 'PROMO%' OR p_type LIKE 'ECONOMY%' OR p_type LIKE '%BRASS' OR p_type LIKE '%TIN') AS review FROM part")
def rule_classify(spark, d):
    name, review = C.classified(F.col("p_type"), RULES, "STEEL")
    return read(spark, d, "part").select("p_partkey", name.alias("class"), review.alias("review"))


TIMES = ("2024-05-01T10:20:30Z", "2024-05-01T10:20:30.123456+02:00", "2024-05-01 10:20:30", "2024-05-01", "soon", "2024-13-01T00:00:00Z", "")


@query("SELECT * FROM (VALUES (0, '2024-05-01T10:20:30.000Z'), (1, '2024-05-01T08:20:30.123Z'), (2, '2024-05-01T10:20:30.000Z'), (3, '2024-05-01T00:00:00.000Z'), (4, NULL), (5, NULL), (6, NULL)) v(i, t) UNION ALL SELECT event_id + 10, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' FROM events")
def iso_ts(spark, d):
    e = read(spark, d, "events").select((F.col("event_id") + 10).alias("i"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("t"))
    return _strings(spark, TIMES).unionByName(e).select("i", C.iso(F.col("t")).alias("t"))


@query(f"""WITH k AS (SELECT c_custkey, encode(c_name) AS m FROM customer) SELECT c_custkey, sha256({"'" + "".join(f"\\x{b ^ 0x5C:02X}" for b in b"secret".ljust(64, bytes(1))) + "'::BLOB"} || unhex(sha256({"'" + "".join(f"\\x{b ^ 0x36:02X}" for b in b"secret".ljust(64, bytes(1))) + "'::BLOB"} || m))) AS code FROM k""")
def hmac_codes(spark, d):
    return read(spark, d, "customer").select("c_custkey", R.hmac_sha256(F.col("c_name"), b"secret").alias("code"))


@query("""WITH t AS (SELECT p_partkey, '"' || sha1(p_partkey || '|' || p_name) || '"' AS tag FROM part) SELECT p_partkey, tag, p_partkey % 4 < 3 AS not_modified FROM t""")
def etag(spark, d):
    tag, k = R.etag(F.concat_ws("|", F.col("p_partkey").cast("string"), "p_name")), F.col("p_partkey") % 4
    header = F.when(k == 0, tag).when(k == 1, F.concat(F.lit('"x", W/'), tag)).when(k == 2, "*").otherwise('"other"')
    return read(spark, d, "part").select("p_partkey", tag.alias("tag"), R.not_modified(tag, header).alias("not_modified"))


@query("SELECT event_id, '\"GET /search?q=-&page=' || event_id || ' HTTP/1.1\" 200' AS line FROM events")
def redact_log(spark, d):
    line = F.concat(F.lit('"GET /search?q=some%20words'), F.col("event_type"), F.lit("&page="), F.col("event_id").cast("string"), F.lit(' HTTP/1.1" 200'))
    return read(spark, d, "events").select("event_id", C.redacted(line).alias("line"))


PATHS = ("a/b.json", "../x", "a/../../x", "/etc/x", "a/../b", "", "./a", "a//b")


@query("SELECT * FROM (VALUES (0, true), (1, false), (2, false), (3, false), (4, true), (5, true), (6, true), (7, true)) v(i, ok)")
def path_guard(spark, d):
    return _strings(spark, PATHS).select("i", C.inside(F.col("t"), "/data/books").alias("ok"))


@query("SELECT n_nationkey, count(s_name) AS n, coalesce(string_agg(s_name, ';' ORDER BY s_name), '') AS line, coalesce(bool_or(s_name = 'Supplier#000000003'), false) AS third FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_nationkey")
def array_agg_order(spark, d):
    s = read(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list("s_name")).alias("a"))
    names = F.coalesce("a", F.array().cast("array<string>"))
    return read(spark, d, "nation").join(s, F.col("s_nationkey") == F.col("n_nationkey"), "left").select("n_nationkey", F.size(names).cast("long").alias("n"), F.array_join(names, ";").alias("line"), F.array_contains(names, "Supplier#000000003").alias("third"))


# Windows and checks of pages

_CHECKED = f"q AS (SELECT book, sequence, doc_id % 9 > 0 AS main, n_chars::DOUBLE AS l, CASE WHEN doc_id % 5 > 0 THEN sequence + (doc_id % 13 = 0)::INT * 3 END AS number, doc_id % 6 = 0 AS heads FROM ({PAGE}) p)"


def _checked(spark, d):
    p = _pages(spark, d, "n_chars")
    k = F.col("doc_id")
    return p.select("book", "sequence", (k % 9 > 0).alias("main"), F.col("n_chars").cast("double").alias("length"), F.when(k % 5 > 0, F.col("sequence") + (k % 13 == 0).cast("int") * 3).alias("number"), (k % 6 == 0).alias("heads"), F.lit(True).alias("text"))


_JUMPS = "j AS (SELECT book, sequence, lag(number) OVER (PARTITION BY book ORDER BY sequence) AS prev, number FROM q WHERE main AND number IS NOT NULL), k AS (SELECT *, CASE WHEN number <= prev THEN 'number-back' ELSE 'number-skip' END AS code FROM j WHERE number <> prev + 1)"


@query("SELECT e.event_id, e.user_id, c.value AS clicked FROM (SELECT * FROM events WHERE event_type = 'purchase') e ASOF LEFT JOIN (SELECT user_id, event_id AS at, value FROM events WHERE event_type = 'click') c ON c.user_id = e.user_id AND e.event_id >= c.at")
def join_asof(spark, d):
    e = read(spark, d, "events")
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", F.col("event_id").alias("at"))
    return windows.as_of(left, e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("at"), F.col("value").alias("clicked")), "user_id", "at", "clicked").drop("at")


@query(f"WITH p AS ({PAGE}), s AS (SELECT book, sequence FROM p WHERE doc_id % 7 = 0) SELECT book, sequence AS start, coalesce((SELECT min(x.sequence) - 1 FROM s x WHERE x.book = s.book AND x.sequence > s.sequence), (SELECT max(y.sequence) FROM p y WHERE y.book = s.book)) AS stop FROM s")
def section_ranges(spark, d):
    p = _pages(spark, d)
    return windows.ranges(p.filter("doc_id % 7 = 0").select("book", F.col("sequence").alias("start")), p.groupBy("book").agg(F.max("sequence").alias("last")))


@query(f"WITH p AS (SELECT *, regexp_matches(text, '[Tt]h') AS front FROM ({PAGE}) t), n AS (SELECT book, count(*) FILTER (WHERE NOT (front AND sequence <= 12)) AS n FROM p GROUP BY book) SELECT p.book, sequence, doc_id FROM p JOIN n ON n.book = p.book WHERE n < 5 OR NOT front OR sequence > 12")
def front_matter_drop(spark, d):
    own = read(spark, d, "documents").select("doc_id", F.col("text").rlike("[Tt]h").alias("front"))
    return windows.without_front(_pages(spark, d).join(own, "doc_id")).select("book", "sequence", "doc_id")


@query(f"WITH {_CHECKED}, {_JUMPS} SELECT * FROM k")
def number_jumps(spark, d):
    return E.jumps(_checked(spark, d))


@query(f"""WITH {_CHECKED}, {_JUMPS}, u AS (SELECT book, list_sort(list(l))[len(list(l)) // 2 + 1] AS usual, count(*) AS n FROM q WHERE main AND l > 0 GROUP BY book),
a AS (SELECT a.book, a.sequence, a.l, a.main, a.heads, usual, n, (SELECT list_sort(list(b.l))[len(list(b.l)) // 2 + 1] FROM q b WHERE b.book = a.book AND b.l <> 0 AND abs(b.sequence - a.sequence) BETWEEN 1 AND 5) AS near,
  p.l AS before, x.l AS after, x.heads AS next_heads FROM q a JOIN u ON u.book = a.book LEFT JOIN q p ON p.book = a.book AND p.sequence = a.sequence - 1 LEFT JOIN q x ON x.book = a.book AND x.sequence = a.sequence + 1),
c AS (SELECT book, sequence, CASE WHEN l > 1.8 * greatest(usual, coalesce(near, usual)) THEN 'long-page' WHEN l < 0.3 * usual AND before > 0 AND after > 0 AND NOT next_heads AND NOT heads THEN 'short-page' END AS code FROM a WHERE main AND l > 0 AND n >= 10),
f AS (SELECT * FROM c WHERE code IS NOT NULL UNION ALL SELECT book, sequence, code FROM k), r AS (SELECT *, row_number() OVER (PARTITION BY book, CASE WHEN code LIKE 'number%' THEN 'n' ELSE code END ORDER BY sequence) AS i FROM f) SELECT book, sequence, code FROM r WHERE i <= 40""")
def page_checks(spark, d):
    return E.page_checks(_checked(spark, d))


@query(f"WITH p AS ({PAGE}), l AS (SELECT book, sequence, length(text) AS l FROM p) SELECT a.book, a.sequence, (SELECT list_sort(list(b.l))[len(list(b.l)) // 2 + 1] FROM l b WHERE b.book = a.book AND b.l > 0 AND abs(b.sequence - a.sequence) BETWEEN 1 AND 5) AS local FROM l a")
def local_median(spark, d):
    return windows.neighbour_median(read(spark, d, "documents"))


@query(f"WITH p AS ({PAGE}), a AS (SELECT book, sequence, CASE WHEN doc_id % 11 = 0 THEN sequence - doc_id % 4 END AS anchor FROM p) SELECT a.book, a.sequence, a.sequence - coalesce((SELECT arg_max(b.sequence - b.anchor, b.sequence) FROM a b WHERE b.book = a.book AND b.anchor IS NOT NULL AND b.sequence <= a.sequence), (SELECT arg_min(b.sequence - b.anchor, b.sequence) FROM a b WHERE b.book = a.book AND b.anchor IS NOT NULL), 0) AS label FROM a")
def ffill_labels(spark, d):
    k = F.col("doc_id")
    return E.labels(_pages(spark, d).withColumn("anchor", F.when(k % 11 == 0, F.col("sequence") - k % 4)))


_NUMBERED = f"p AS ({PAGE}), q AS (SELECT book, sequence, CASE WHEN doc_id % 3 > 0 THEN CASE WHEN sequence <= 6 THEN sequence ELSE sequence - 6 END END AS printed, n_chars < 100 AS blank FROM p), s AS (SELECT a.book, min(a.sequence) AS split FROM q a JOIN q b ON b.book = a.book AND b.sequence < a.sequence AND b.printed > a.printed GROUP BY a.book), n AS (SELECT q.book, q.sequence, q.blank, CASE WHEN q.sequence < split THEN 'frontMatter' ELSE 'main' END AS type, CASE WHEN q.sequence < split THEN '0.' || q.sequence ELSE coalesce(printed, q.sequence)::VARCHAR END AS number FROM q LEFT JOIN s ON s.book = q.book)"


def _printed(spark, d):
    s = F.col("sequence")
    return _pages(spark, d, "n_chars").withColumn("printed", F.when(F.col("doc_id") % 3 > 0, F.when(s <= 6, s).otherwise(s - 6))).withColumn("blank", F.col("n_chars") < 100)


@query(f"WITH {_NUMBERED} SELECT book, sequence, type, number FROM n")
def page_number(spark, d):
    return E.page_numbers(_printed(spark, d))


@query(f"WITH {_NUMBERED} SELECT book, count(*) AS pages, count(*) FILTER (WHERE type = 'main') AS main, count(*) FILTER (WHERE type <> 'main') AS front, count(*) FILTER (WHERE blank) AS blank, min(try_cast(number AS INT)) FILTER (WHERE type = 'main') AS first, max(try_cast(number AS INT)) FILTER (WHERE type = 'main') AS last FROM n GROUP BY book")
def book_summary(spark, d):
    p = _printed(spark, d)
    return E.summary(E.page_numbers(p).join(p.select("book", "sequence", "blank"), ["book", "sequence"]))


@query("""WITH f AS (SELECT DISTINCT p_brand AS title, CASE WHEN p_size % 5 > 0 THEN p_size % 5 END AS author FROM part), k AS (SELECT p_brand AS title, CASE WHEN p_size % 5 > 0 THEN p_size % 5 END AS author, min(p_partkey) AS id FROM part WHERE p_partkey % 17 = 0 GROUP BY ALL),
m AS (SELECT f.title, f.author, id FROM f LEFT JOIN k ON f.title = k.title AND f.author IS NOT DISTINCT FROM k.author)
SELECT title, author, coalesce(id, (SELECT max(p_partkey) FROM part WHERE p_partkey % 17 = 0) + row_number() OVER (PARTITION BY id IS NULL ORDER BY title, author NULLS FIRST)) AS id FROM m""")
def natural_key(spark, d):
    p = read(spark, d, "part").select(F.col("p_brand").alias("title"), F.when(F.col("p_size") % 5 > 0, F.col("p_size") % 5).alias("author"), F.col("p_partkey").alias("id"))
    return E.keyed(p, p.filter("id % 17 = 0"), ["title", "author"], "id")


@query("SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'tr' WHEN p_partkey % 7 = 0 THEN 'fa' WHEN p_partkey % 3 = 0 THEN 'ur' ELSE 'ar' END AS language FROM part")
def lang_resolve(spark, d):
    k = F.col("p_partkey")
    given = F.when(k % 5 == 0, " TR ").when(k % 2 == 0, " ")
    return read(spark, d, "part").select("p_partkey", E.language(given, F.when(k % 7 == 0, F.concat("p_name", F.lit(" (فارسي)"))).otherwise(F.col("p_name")), F.when(k % 3 == 0, "ur")).alias("language"))


@query("SELECT doc_id, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS letters, length(regexp_replace(left(text, 500), '[^\\p{L}]', '', 'g')) AS kept FROM documents")
def coverage(spark, d):
    a, b = E.coverage(F.col("text"), F.substring("text", 1, 500))
    return read(spark, d, "documents").select("doc_id", a.cast("long").alias("letters"), b.cast("long").alias("kept"))


@query()
def contents_run(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").cast("string").alias("book"), F.col("event_id").alias("nth"), (F.col("event_id") / 50 + F.col("value") % 7).cast("long").alias("number"))
    return E.contents_run(e)


def _anchors(spark, d):
    """Every fourth page is an anchor, some of them wrong; every tenth page is empty."""
    p = _pages(spark, d).withColumn("blank", F.col("doc_id") % 10 == 0)
    a = p.filter("doc_id % 4 = 0").select("book", "sequence", (F.col("sequence") - F.when(F.col("doc_id") % 28 == 0, F.col("doc_id") % 9).otherwise(0)).alias("number"))
    return a, p.select("book", "sequence", "blank")


@query()
def anchor_chain(spark, d):
    return E.steady(*_anchors(spark, d))


@query(f"""WITH p AS ({PAGE}), a AS (SELECT book, sequence, sequence - sequence // 9 AS number FROM p WHERE doc_id % 4 = 0), g AS (SELECT book, sequence AS lo, lead(sequence) OVER w AS hi, lead(sequence - number) OVER w - (sequence - number) AS extra FROM a WINDOW w AS (PARTITION BY book ORDER BY sequence)),
e AS (SELECT p.book, p.sequence, extra, row_number() OVER (PARTITION BY p.book, lo ORDER BY p.sequence) AS i FROM p JOIN g ON g.book = p.book AND p.sequence > lo AND p.sequence < hi WHERE extra > 0 AND doc_id % 10 = 0) SELECT book, sequence FROM e WHERE i <= extra""")
def artifact_pages(spark, d):
    p = _pages(spark, d).withColumn("blank", F.col("doc_id") % 10 == 0)
    return E.artifacts(p.filter("doc_id % 4 = 0").select("book", "sequence", (F.col("sequence") - F.floor(F.col("sequence") / 9)).alias("number")), p.select("book", "sequence", "blank"))


@query(f"""WITH p AS ({PAGE}), a AS (SELECT book, sequence, sequence - (doc_id % 5 = 0)::INT AS number FROM p WHERE doc_id % 2 = 0), o AS (SELECT *, sequence - number AS o, lag(sequence - number) OVER w AS b, lead(sequence - number) OVER w AS f FROM a WINDOW w AS (PARTITION BY book ORDER BY sequence, number)) SELECT book, sequence, number FROM o WHERE NOT coalesce(b = f AND o <> b, false)""")
def anchor_outliers(spark, d):
    return E.without_outliers(_pages(spark, d).filter("doc_id % 2 = 0").select("book", "sequence", (F.col("sequence") - (F.col("doc_id") % 5 == 0).cast("int")).alias("number")))


def _entries(spark, d):
    words = T.tokens(F.lower("text"))
    b = read(spark, d, "benchmark").select((F.col("item_id") % 5).cast("string").alias("book"), F.col("item_id").alias("entry"), "text")
    entries = b.select("book", "entry", F.substring(F.lower("text"), 1, 60).alias("key"), F.slice(words, 1, 8).alias("words"), F.floor(F.col("entry") / 5).cast("long").alias("expected"))
    lines = b.select("book", F.col("entry").alias("line"), (F.floor(F.col("entry") / 5) + F.col("entry") % 3).cast("long").alias("page"), F.when(F.col("entry") % 2 == 0, F.concat(F.lit("x"), F.substring(F.lower("text"), 1, 80))).otherwise(F.reverse(F.substring(F.lower("text"), 1, 80))).alias("key"), F.slice(words, 3, 10).alias("words"))
    return entries, lines


@query()
def fuzzy_headings(spark, d):
    return E.fuzzy_headings(*_entries(spark, d))


@query(f"""WITH b AS (SELECT item_id, {WORDS} AS w FROM benchmark) SELECT a.item_id, b.item_id AS other, len(list_intersect(list_distinct(a.w), list_distinct(b.w))) AS shared,
  round(len(list_intersect(list_distinct(a.w), list_distinct(b.w))) / least(len(list_distinct(a.w)), len(list_distinct(b.w)))::DOUBLE, 9) AS share FROM b a JOIN b ON b.item_id = a.item_id + 1""")
def word_overlap(spark, d):
    w = read(spark, d, "benchmark").select("item_id", T.tokens(F.lower("text")).alias("w"))
    n, share = E.shared_words(F.col("w"), F.col("w2"))
    return w.join(w.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("other"), F.col("w").alias("w2")), "item_id").select("item_id", "other", n.alias("shared"), F.round(share, 9).alias("share"))


@query()
def page_map(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("page"), T.tokens(F.lower("text")).alias("words"))
    return E.page_map(docs, docs.select((F.col("page") + 2).alias("page"), F.slice("words", 2, 400).alias("words")))


# Retrieval lists

_MEANING = "m AS (SELECT source AS book, doc_id AS sequence, left(text, 300) AS text, row_number() OVER (ORDER BY n_chars DESC, doc_id) - 1 AS rank FROM (SELECT * FROM documents ORDER BY n_chars DESC, doc_id LIMIT 200) t), w AS (SELECT source AS book, doc_id AS sequence, 'w ' || left(text, 300) AS text, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM (SELECT * FROM documents WHERE lang = 'en' ORDER BY doc_id LIMIT 200) t)"


def _lists(spark, d):
    """Two lists of candidates: the longest pages, and the first English ones."""
    docs = read(spark, d, "documents")
    page = lambda rows, order, text: first_page(rows, order, 1, 200, "rank").select(F.col("source").alias("book"), F.col("doc_id").alias("sequence"), text.alias("text"), (F.col("rank") - 1).alias("rank"))
    start = F.substring("text", 1, 300)
    return page(docs, [F.desc("n_chars"), F.col("doc_id")], start), page(docs.filter("lang = 'en'"), [F.col("doc_id")], F.concat(F.lit("w "), start))


@query(f"""WITH {_MEANING}, f AS (SELECT book, sequence, round(sum(1.0::DOUBLE / (61 + rank)), 12) AS score FROM (SELECT book, sequence, rank FROM m UNION ALL SELECT book, sequence, rank FROM w) t GROUP BY ALL),
x AS (SELECT f.*, coalesce(m.text, w.text) AS text FROM f LEFT JOIN m USING (book, sequence) LEFT JOIN w USING (book, sequence)), s AS (SELECT *, left(regexp_replace({norm_sql("text")}, '[^\\p{{L}}\\p{{N}}_]', '', 'g'), 200) AS sig FROM x),
r AS (SELECT *, row_number() OVER (PARTITION BY sig ORDER BY score DESC, book, sequence) AS nth FROM s) SELECT book, sequence, text, score, row_number() OVER (ORDER BY score DESC, book, sequence) AS place FROM r WHERE nth = 1 OR sig = ''""")
def merge_dedup(spark, d):
    return C.merged_candidates(*_lists(spark, d))


@query(f"WITH {_MEANING} SELECT sequence AS k, round(sum(1.0::DOUBLE / (61 + rank)), 12) AS score FROM (SELECT sequence, rank FROM m UNION ALL SELECT sequence, rank FROM w) t GROUP BY sequence")
def rrf(spark, d):
    return C.fused([x.select(F.col("sequence").alias("k"), "rank") for x in _lists(spark, d)], ["k"])


ASKED = ("of the", "in THE", "de la", "und die")


@query(rf"""WITH d AS (SELECT doc_id, lang = 'en' AS scoped, ' ' || array_to_string(list_filter(string_split_regex({norm_sql("text")}, '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''), ' ') || ' ' AS line FROM documents),
h AS (SELECT doc_id, row_number() OVER (PARTITION BY k ORDER BY scoped DESC, doc_id) AS r FROM d JOIN (VALUES ('of the'), ('in the'), ('de la'), ('und die')) v(k) ON contains(line, ' ' || k || ' ')) SELECT doc_id, round(sum(1.0::DOUBLE / (60 + r)), 12) AS score FROM h WHERE r <= 6 GROUP BY doc_id""")
def word_leg(spark, d):
    index = search.indexed(read(spark, d, "documents").select("doc_id", "text", (F.col("lang") == "en").alias("scoped")))
    return search.word_leg(index, list(ASKED))


PICKS = ([3, 1, 99, 3, 2], [], [0, -1], [5, 4, 3, 2, 1], None)


@query("SELECT * FROM (VALUES (0, '3,1,2'), (1, '1,2,3'), (2, '1,2,3'), (3, '5,4,3'), (4, '1,2,3')) v(ask, picks)")
def rerank_apply(spark, d):
    a = spark.createDataFrame([(i, x, 6) for i, x in enumerate(PICKS)], "ask int, picks array<int>, n int")
    out = C.reranked(a.withColumn("picks", F.coalesce("picks", F.array().cast("array<int>"))), 3)
    return out.select("ask", F.array_join("picks", ",").alias("picks"))


ANSWERS = ('{"queries": ["a", 1, "b", null, "c", "d"], "keywords": "x", "authors": ["p", "q", "r"]}', '{"queries": [], "books": ["one"]}', "no json", '{"keywords": ["k1", ["k2"], "k3"]}')


@query("SELECT * FROM (VALUES (0, 'a|b|c', '', 'p|q', ''), (1, '', '', '', 'one'), (2, '', '', '', ''), (3, '', 'k1|k3', '', '')) v(ask, queries, keywords, authors, books)")
def rewrite_parse(spark, d):
    out = C.rewritten(spark.createDataFrame(list(enumerate(ANSWERS)), "ask int, answer string"))
    return out.select("ask", *[F.array_join(c, "|").alias(c) for c in ("queries", "keywords", "authors", "books")])


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN text || '|' || role ELSE text || '|' || role || '|user' END AS queries FROM conversations WHERE text NOT IN ('user', 'assistant', 'system')")
def query_set(spark, d):
    c = read(spark, d, "conversations").filter("text NOT IN ('user', 'assistant', 'system')")
    return c.select("conv_id", "turn", F.array_join(C.query_set(F.col("text"), F.array(F.col("role"), F.col("text"), F.lit("user"))), "|").alias("queries"))


@query("SELECT vec_id, label, 'wide' AS scope FROM embeddings WHERE label IN (1, 2) UNION ALL SELECT vec_id, label, 'narrow' FROM embeddings WHERE vec_id < 20")
def scope_fallback(spark, d):
    e = read(spark, d, "embeddings").select("vec_id", "label")
    one = C.scoped(e, spark.createDataFrame([(1,), (2,)], "id int"), "label").withColumn("scope", F.lit("wide"))
    return one.unionByName(C.scoped(e.filter("vec_id < 20"), spark.createDataFrame([(99,)], "id int"), "label").withColumn("scope", F.lit("narrow")))


@query("""SELECT '[' || string_agg('{"work_id":' || work_id || ',"title":"' || title || '"}', ',' ORDER BY title, work_id) || ']' AS items, any_value(n) AS total, 3 AS page, 7 AS "limit", any_value(n) > 21 AS has_more FROM (SELECT p_partkey AS work_id, p_name AS title, row_number() OVER (ORDER BY p_name, p_partkey) AS r, count(*) OVER () AS n FROM part) t WHERE r BETWEEN 15 AND 21""")
def page_envelope(spark, d):
    w = shelves.works_of(spark, d).select("work_id", "title")
    out = C.envelope(w, [F.col("title"), F.col("work_id")], 3, 7)
    return out.withColumn("items", F.to_json("items"))


# Changes and sync

@query("""WITH o AS (SELECT * FROM part WHERE p_partkey % 10 <> 1), n AS (SELECT p_partkey, p_name, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_brand END AS p_brand, p_size FROM part WHERE p_partkey % 10 <> 2)
SELECT coalesce(o.p_partkey, n.p_partkey) AS p_partkey, CASE WHEN o.p_partkey IS NULL THEN 'insert' WHEN n.p_partkey IS NULL THEN 'delete' ELSE 'update' END AS op FROM o FULL JOIN n ON o.p_partkey = n.p_partkey
WHERE o.p_partkey IS NULL OR n.p_partkey IS NULL OR o.p_name IS DISTINCT FROM n.p_name OR o.p_brand IS DISTINCT FROM n.p_brand OR o.p_size IS DISTINCT FROM n.p_size""")
def cdc_diff(spark, d):
    p = read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return R.row_changes(p.filter("p_partkey % 10 <> 1"), p.filter("p_partkey % 10 <> 2").withColumn("p_brand", F.when(F.col("p_partkey") % 7 > 0, F.col("p_brand"))), "p_partkey")


_BOOK_ID = "concat_ws('-', l_orderkey::VARCHAR, l_linenumber::VARCHAR, l_partkey::VARCHAR, l_suppkey::VARCHAR, round(l_extendedprice * 100)::BIGINT::VARCHAR, l_shipdate::DATE::VARCHAR)"


@query(f"SELECT DISTINCT {_BOOK_ID} AS book_id FROM lineitem WHERE l_partkey IN (3, 5) OR l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_nationkey = 4) OR l_partkey IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#13' AND p_size < 10)")
def touched_books(spark, d):
    b = shelves.books_of(spark, d)
    w = shelves.works_of(spark, d)
    return R.touched(b, [(w.filter("work_id IN (3, 5)").select("work_id"), "work_id"), (read(spark, d, "supplier").filter("s_nationkey = 4").select("s_suppkey"), "author_id"), (w.filter("subject = 'Brand#13' AND featured_order < 10").select("work_id"), "work_id")])


@query("""WITH a AS (SELECT event_id AS seq, user_id AS id FROM events WHERE event_id > 300 ORDER BY event_id LIMIT 101) SELECT seq, id, CASE WHEN EXISTS (SELECT 1 FROM events p WHERE p.user_id = id AND p.event_type = 'signup') THEN 'upsert' ELSE 'delete' END AS op, (SELECT count(*) > 100 FROM a) AS has_more FROM a ORDER BY seq LIMIT 100""")
def change_feed(spark, d):
    e = read(spark, d, "events")
    return R.feed(e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("id")), e.filter("event_type = 'signup'").select(F.col("user_id").alias("id")), 300, 100)


@query("SELECT event_id, event_id // 7 AS writer FROM events WHERE event_id // 7 < (SELECT min(event_id // 7) FROM events WHERE event_type = 'error' AND event_id > 200)")
def horizon_filter(spark, d):
    e = read(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 7).alias("writer"), "event_type")
    return R.settled(e.drop("event_type"), e.filter("event_type = 'error' AND event_id > 200").select("writer"))


_CLOCK = "CASE WHEN event_id % 6 > 0 THEN epoch_us(ts) // 3600000000 END"


@query(f"SELECT user_id, k, event_id FROM (SELECT user_id, event_id % 3 AS k, event_id, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY {_CLOCK} DESC NULLS LAST, event_type DESC, event_id DESC) AS r FROM events) t WHERE r = 1")
def lww_order(spark, d):
    c = read(spark, d, "events").select("user_id", (F.col("event_id") % 3).alias("k"), "event_id", "event_type", F.when(F.col("event_id") % 6 > 0, F.floor(_us() / R.HOUR)).alias("clock"))
    return R.last_writes(c, ["user_id", "k"], "clock", "event_type", "event_id").select("user_id", "k", "event_id")


NOW = 1_704_067_200 * R.SECOND


@query(f"""WITH i AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'note' WHEN 'view' THEN 'bookmark' WHEN 'purchase' THEN 'progress' WHEN 'error' THEN NULL ELSE event_type END AS kind, CASE WHEN event_id % 13 = 0 THEN '' WHEN event_id % 17 = 0 THEN repeat('k', 513) ELSE 'Key' || event_id END AS key,
  CASE WHEN event_id % 19 = 0 THEN NULL WHEN event_id % 23 = 0 THEN '[1]' WHEN event_id % 29 = 0 THEN '{{"a":"' || repeat('x', 262144) || '"}}' ELSE props END AS data, event_id % 5 = 0 AS deleted, CASE WHEN event_id % 31 = 0 THEN NULL WHEN event_id % 37 = 0 THEN 5 ELSE {NOW} + (event_id % 7 - 3) * 200000000 END AS u, {NOW} + (event_id % 3) * 400000000 AS m FROM events)
SELECT event_id, CASE WHEN kind IS NULL OR kind NOT IN ('note', 'bookmark', 'progress') THEN 'rejected_kind' WHEN length(key) NOT BETWEEN 1 AND 512 THEN 'rejected_key' WHEN strlen(data) > 262144 OR left(data, 1) <> '{{' THEN 'rejected_size' WHEN u IS NULL OR u < 1577836800000000 THEN 'rejected_time' ELSE 'ok' END AS status,
  CASE WHEN u > {NOW} + 300000000 THEN {NOW} ELSE u END AS updated_us, CASE WHEN m > {NOW} + 300000000 THEN {NOW} ELSE m END AS moved_us, lower(key) AS key_lower, CASE WHEN deleted THEN -1 ELSE strlen(coalesce(data, '{{}}')) END AS n_bytes FROM i""")
def sync_validate(spark, d):
    k = F.col("event_id")
    kind = F.when(F.col("event_type") == "click", "note").when(F.col("event_type") == "view", "bookmark").when(F.col("event_type") == "purchase", "progress").when(F.col("event_type") != "error", F.col("event_type"))
    key = F.when(k % 13 == 0, "").when(k % 17 == 0, F.repeat(F.lit("k"), 513)).otherwise(F.concat(F.lit("Key"), k.cast("string")))
    data = F.when(k % 19 == 0, F.lit(None)).when(k % 23 == 0, "[1]").when(k % 29 == 0, F.concat(F.lit('{"a":"'), F.repeat(F.lit("x"), 262144), F.lit('"}'))).otherwise(F.col("props"))
    items = read(spark, d, "events").select("event_id", kind.alias("kind"), key.alias("key"), data.alias("data"), (k % 5 == 0).alias("deleted"), F.when(k % 31 == 0, F.lit(None)).when(k % 37 == 0, 5).otherwise(F.lit(NOW) + (k % 7 - 3) * 200 * R.SECOND).alias("updated_us"), (F.lit(NOW) + k % 3 * 400 * R.SECOND).alias("moved_us"))
    out = R.checked_push(items, NOW)
    return out.select("event_id", "status", "updated_us", "moved_us", "key_lower", F.coalesce(F.octet_length("data"), F.lit(-1)).cast("long").alias("n_bytes"))


@query("SELECT p_name || ' ' || p_partkey AS name FROM part WHERE p_partkey > 5 AND p_partkey % 4 > 0 AND NOT (p_partkey % 3 = 0 AND p_partkey > 2) ORDER BY p_partkey LIMIT 1")
def claim_next(spark, d):
    p = read(spark, d, "part").select(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("name"), F.col("p_partkey").alias("nth"))
    claims = p.filter("nth % 3 = 0").select("name", F.when(F.col("nth") > 2, F.lit(R.HOUR)).otherwise(0).alias("at_us"))
    return R.next_claim(p, p.filter("nth <= 5"), p.filter("nth % 4 = 0"), claims, 3 * R.HOUR + 1)


@query("SELECT 'all' AS of, coalesce(max(event_id), 0) AS seq FROM events UNION ALL SELECT 'none', 0")
def latest_seq(spark, d):
    e = read(spark, d, "events").select(F.col("event_id").alias("seq"))
    return R.latest(e).select(F.lit("all").alias("of"), "seq").unionByName(R.latest(e.filter("seq < 0")).select(F.lit("none").alias("of"), "seq"))


# Limits and notices

_CALLS = "c AS (SELECT event_id AS id, epoch_us(ts) AS us, user_id AS email, user_id % 4 AS ip FROM events)"


@query(f"""WITH {_CALLS}, w AS (SELECT id, us, us - lag(us) OVER (PARTITION BY email ORDER BY us, id) AS since, (SELECT count(*) FROM c b WHERE b.email = a.email AND b.us <= a.us AND b.us > a.us - 3600000000) AS ne, (SELECT min(us) FROM c b WHERE b.email = a.email AND b.us <= a.us AND b.us > a.us - 3600000000) AS oe,
  (SELECT count(*) FROM c b WHERE b.ip = a.ip AND b.us <= a.us AND b.us > a.us - 3600000000) AS ni, (SELECT min(us) FROM c b WHERE b.ip = a.ip AND b.us <= a.us AND b.us > a.us - 3600000000) AS oi FROM c a)
SELECT id, CASE WHEN since < 600000000 THEN 'resend_gap' WHEN ne > 1 THEN 'email' WHEN ni > 3 THEN 'ip' ELSE 'ok' END AS verdict, CASE WHEN since < 600000000 THEN 600000000 - since WHEN ne > 1 THEN oe + 3600000000 - us WHEN ni > 3 THEN oi + 3600000000 - us END AS retry_us FROM w""")
def rate_hour(spark, d):
    c = read(spark, d, "events").select(F.col("event_id").alias("id"), _us().alias("us"), F.col("user_id").alias("email"), (F.col("user_id") % 4).alias("ip"))
    return R.code_requests(c, by_email=1, by_ip=3, gap_us=600 * R.SECOND)


@query("""WITH c AS (SELECT event_id AS id, epoch_us(ts) AS us, user_id % 20 AS who, (event_type = 'error')::INT AS running, epoch_us(ts) // 86400000000 AS day FROM events),
w AS (SELECT id, count(*) OVER (PARTITION BY day ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s, count(*) OVER m AS n, coalesce(sum(running) OVER m, 0) AS o, count(*) OVER (PARTITION BY who ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) - 1 AS q FROM c WINDOW m AS (PARTITION BY who, day ORDER BY us, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT id, CASE WHEN s >= 300 THEN 'service' WHEN n >= 12 THEN 'daily' WHEN o >= 2 THEN 'in_flight' WHEN q >= 1 THEN 'per_minute' ELSE 'ok' END AS verdict FROM w""")
def quota_verdict(spark, d):
    c = read(spark, d, "events").select(F.col("event_id").alias("id"), _us().alias("us"), (F.col("user_id") % 20).alias("who"), (F.col("event_type") == "error").alias("running"))
    return R.quotas(c, daily=12, at_once=2, minute=1, service=300)


_ZONE = "CASE event_id % 3 WHEN 0 THEN 'Asia/Baghdad' WHEN 1 THEN 'Europe/Berlin' ELSE 'UTC' END"


@query(f"""WITH e AS (SELECT event_id, {_ZONE} AS z, (ts AT TIME ZONE 'UTC') AT TIME ZONE {_ZONE} AS l FROM events), h AS (SELECT *, date_trunc('day', l) + INTERVAL 8 HOUR + CASE WHEN hour(l) >= 22 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS m FROM e)
SELECT event_id, CASE WHEN hour(l) >= 22 OR hour(l) < 8 THEN epoch_us((m AT TIME ZONE z) AT TIME ZONE 'UTC') END AS allowed_us FROM h""")
def quiet_hours(spark, d):
    k = F.col("event_id") % 3
    zone = F.when(k == 0, "Asia/Baghdad").when(k == 1, "Europe/Berlin").otherwise("UTC")
    at = F.col("ts").cast("timestamp_ntz")
    return read(spark, d, "events").select("event_id", F.unix_micros(R.next_allowed(at, zone).cast("timestamp")).alias("allowed_us"))


@query(f"""WITH t AS (SELECT max(ts) AS top FROM events), n AS (SELECT date_trunc('day', top) + INTERVAL 7 HOUR + INTERVAL 30 MINUTE AS now FROM t), u AS (SELECT user_id, CASE user_id % 2 WHEN 0 THEN 'Asia/Baghdad' ELSE 'UTC' END AS z, CASE WHEN user_id % 3 > 0 THEN max(ts) END AS last_sent, min(ts) AS updated FROM events GROUP BY user_id),
d AS (SELECT user_id, greatest(coalesce(last_sent, updated), updated) AS since FROM u, n WHERE hour((now AT TIME ZONE 'UTC') AT TIME ZONE z) = 10 AND (last_sent IS NULL OR now - last_sent >= INTERVAL 20 HOUR)),
w AS (SELECT event_type AS work_id, 'title ' || event_type AS title, ts AS seen FROM events) SELECT user_id, count(DISTINCT work_id) AS n, CASE WHEN count(DISTINCT work_id) = 1 THEN max(title) END AS one FROM d JOIN w ON seen > since GROUP BY user_id""")
def digest(spark, d):
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    now = F.broadcast(e.agg((F.date_trunc("day", F.max("ts")).cast("timestamp_ntz") + F.make_dt_interval(hours=F.lit(7), mins=F.lit(30))).alias("now")))
    users = e.groupBy("user_id").agg(F.max("ts").alias("top"), F.min("ts").alias("updated")).crossJoin(now)
    users = users.select("user_id", F.when(F.col("user_id") % 2 == 0, "Asia/Baghdad").otherwise("UTC").alias("zone"), F.when(F.col("user_id") % 3 > 0, F.col("top")).alias("last_sent"), "updated", "now")
    works = e.select(F.col("event_type").alias("work_id"), F.concat(F.lit("title "), F.col("event_type")).alias("title"), F.col("ts").alias("first_seen"))
    return R.digests(users, works, F.col("now"))


@query("SELECT event_id, event_type FROM events WHERE ts >= (SELECT max(ts) FROM events) - CASE event_type WHEN 'click' THEN INTERVAL 1 DAY WHEN 'view' THEN INTERVAL 3 DAY WHEN 'error' THEN INTERVAL 7 DAY ELSE INTERVAL 9999 DAY END")
def retention(spark, d):
    e = read(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    own = e.crossJoin(F.broadcast(e.agg(F.max("ts").alias("now"))))
    return R.kept(own, "event_type", "ts", F.col("now"), {"click": 1, "view": 3, "error": 7}).select("event_id", "event_type")


@query("""WITH u AS (SELECT event_id AS id, user_id AS session, (event_id * 7919) % 5 AS token, epoch_us(ts) AS us FROM events), n AS (SELECT *, (SELECT count(*) FROM u b WHERE b.session = a.session AND b.token = a.token AND (b.us, b.id) < (a.us, a.id)) AS used FROM u a),
e AS (SELECT session, min({'us': us, 'id': id}) AS stop FROM n WHERE used > 0 GROUP BY session) SELECT id, CASE WHEN used = 0 AND (stop IS NULL OR {'us': us, 'id': id} < stop) THEN 'rotated' WHEN {'us': us, 'id': id} = stop THEN 'reuse_revokes' ELSE 'refresh_invalid' END AS verdict FROM n LEFT JOIN e USING (session)""")
def token_rotation(spark, d):
    return R.rotations(read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("session"), (F.col("event_id") * 7919 % 5).alias("token"), _us().alias("us")))
