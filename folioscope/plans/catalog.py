"""Catalog, filter, join, aggregate, set, window, change-feed and limit queries, as SQL for Catalyst.

Library entities stand on the input's tables: works are parts, authors suppliers, books line items, pages documents.
"""

from __future__ import annotations

from .dialect import Spark

KEY = "concat_ws('-', CAST(l_orderkey AS {t}), CAST(l_linenumber AS {t}), CAST(l_partkey AS {t}), CAST(l_suppkey AS {t}), CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS {t}), CAST(CAST(l_shipdate AS DATE) AS {t}))"


def books(d):
    return f"books AS (SELECT {KEY.format(t=d.text)} AS book_id, l_partkey AS work_id, l_suppkey AS author_id, l_linenumber AS volume, CAST(l_quantity * 100 AS BIGINT) AS bytes, l_returnflag <> 'R' AS published, l_linestatus AS language, l_orderkey, l_shipdate FROM lineitem)"


WORKS = "works AS (SELECT p_partkey AS work_id, p_name AS title, p_brand AS subject, p_type AS library, p_size <= 5 AS featured, p_size AS featured_order FROM part)"
AUTHORS = "authors AS (SELECT s_suppkey AS author_id, s_name AS name, s_nationkey, CASE WHEN s_nationkey % 3 = 0 THEN NULL WHEN s_nationkey % 3 = 1 THEN 'ق ' || CAST(s_nationkey AS STRING) ELSE CAST(300 + s_nationkey AS STRING) END AS death_label FROM supplier)"
PAGES = "pages_of AS (SELECT source AS book, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS sequence, doc_id, text, lang FROM documents)"


def base(d):
    return f"WITH {books(d)}, {WORKS}, {AUTHORS.replace('STRING', d.text)}, {PAGES}"


QUERIES = {}


def plain(name, sql):
    QUERIES[name] = lambda d: f"{base(d)} {sql.format(d=d)}"


# Sources and filters
plain("unnest_ordinality", "SELECT e.i AS position, b.work_id, b.title FROM (SELECT 0 AS i, 12 AS id UNION ALL SELECT 1, 5 UNION ALL SELECT 2, 77) e JOIN works b ON b.work_id = e.id")
plain("filter_and_or", "SELECT book_id FROM books b JOIN works w USING (work_id) WHERE published AND subject IN ('Brand#11', 'Brand#23', 'Brand#12') AND language IN ('O', 'F') AND author_id <= 40")
plain("filter_or_union", "SELECT book_id FROM books b JOIN works w USING (work_id) WHERE published AND subject = 'Brand#12' AND language = 'O' UNION SELECT book_id FROM books WHERE published AND work_id IN (1, 2, 3)")
plain("exists_semi", "SELECT work_id, title FROM works w WHERE EXISTS (SELECT 1 FROM books b WHERE b.work_id = w.work_id AND b.published AND b.volume = 7)")
plain("distinct_from", "SELECT a.work_id, count(*) AS n FROM books a JOIN works w USING (work_id) WHERE a.language IS DISTINCT FROM CASE WHEN featured THEN 'O' END GROUP BY a.work_id")
plain("whole_word", "SELECT doc_id FROM documents WHERE contains(concat(' ', text, ' '), ' the ')")
QUERIES["json_field"] = lambda d: f"SELECT event_id, CAST({d.json('props', 'k')} AS BIGINT) AS k FROM events WHERE CAST({d.json('props', 'k')} AS BIGINT) < 20"
plain("proj_contract", "SELECT CAST(w.work_id AS {d.text}) AS id, title, coalesce(max(name), '') AS author, coalesce(sum(bytes), 0) AS size FROM works w LEFT JOIN books b ON b.work_id = w.work_id AND published AND volume = 1 LEFT JOIN authors a USING (author_id) GROUP BY w.work_id, title")

# Catalog
plain("list_works", "SELECT w.work_id, title, n AS volumes, size FROM (SELECT work_id, count(*) AS n, coalesce(sum(bytes), 0) AS size FROM books WHERE published GROUP BY work_id) b JOIN works w USING (work_id)")
plain("featured", "SELECT work_id, row_number() OVER (ORDER BY featured_order, title, work_id) AS position FROM works WHERE featured")
QUERIES["work_detail"] = lambda d: f"{base(d)} SELECT w.work_id, title, coalesce(sum(bytes), 0) AS size, {d.agg('book_id', 'volume, book_id')} AS volumes FROM works w JOIN books b ON b.work_id = w.work_id WHERE published GROUP BY w.work_id, title"
plain("list_books", "SELECT book_id, title, volume FROM books JOIN works USING (work_id) WHERE published AND language = 'O' ORDER BY title, volume NULLS FIRST, book_id LIMIT 50 OFFSET 100")
plain("title_rank", "SELECT work_id, CASE WHEN lower(title) = 'part 1' THEN 0 WHEN starts_with(lower(title), 'part') THEN 1 WHEN contains(lower(title), 'part') THEN 2 WHEN contains(lower(title), 'a') AND contains(lower(title), 'r') THEN 3 ELSE 4 END AS rank, CAST(length(title) AS BIGINT) AS len FROM works".replace("starts_with(lower(title), 'part')", "left(lower(title), 4) = 'part'"))
plain("books_by_ids", "SELECT book_id, work_id FROM books WHERE published AND work_id IN (3, 14, 15, 92, 65)")
plain("list_authors", "SELECT author_id, name, CASE WHEN left(lower(name), 8) = 'supplier' THEN 0 ELSE 1 END AS rank FROM authors WHERE contains(lower(name), '1') AND contains(lower(name), '0')")
QUERIES["subjects_pins"] = lambda d: f"{base(d)} SELECT s.subject, p.pins FROM (SELECT DISTINCT subject FROM works) s LEFT JOIN (SELECT subject, {d.agg(f'CAST(work_id AS {d.text})', 'featured_order, work_id')} AS pins FROM works WHERE featured_order <= 2 GROUP BY subject) p ON p.subject = s.subject"
plain("libraries_order", "SELECT id, parent, row_number() OVER (ORDER BY parent NULLS FIRST, id) AS position FROM (SELECT n_name AS id, r_name AS parent FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT r_name, NULL FROM region) t")
plain("rep_collection", "SELECT b.work_id, w.library FROM (SELECT work_id, min(book_id) AS book_id FROM books WHERE published GROUP BY work_id) b JOIN works w USING (work_id) WHERE w.library IS NOT NULL")
plain("subject_counts", "SELECT subject, count(DISTINCT w.work_id) AS works, count(b.book_id) AS books FROM works w LEFT JOIN books b ON b.work_id = w.work_id GROUP BY subject")
QUERIES["category_list"] = lambda d: f"{base(d)} SELECT w.subject, n, names FROM (SELECT subject, count(*) AS n FROM works GROUP BY subject) w LEFT JOIN (SELECT subject, {d.agg('title', 'title, work_id')} AS names FROM works WHERE featured GROUP BY subject) f ON f.subject = w.subject"
QUERIES["featured_list"] = lambda d: f"{base(d)} SELECT w.work_id, title, {d.agg('book_id', 'book_id')} AS books FROM works w JOIN books b ON b.work_id = w.work_id WHERE featured AND published GROUP BY w.work_id, title"
plain("subject_detail", "SELECT w.work_id, title, count(b.book_id) AS n FROM works w LEFT JOIN books b ON b.work_id = w.work_id AND published WHERE subject = 'Brand#13' GROUP BY w.work_id, title")
plain("library_tree", "SELECT n.n_name AS id, p.r_name AS parent, count(DISTINCT s_suppkey) AS authors FROM nation n JOIN region p ON p.r_regionkey = n.n_regionkey LEFT JOIN supplier ON s_nationkey = n.n_nationkey GROUP BY n.n_name, p.r_name")
plain("admin_search", "SELECT work_id, title, subject FROM works WHERE contains(lower(title), 'ar') OR contains(lower(subject), '#1') ORDER BY work_id LIMIT 200")
plain("swap_neighbor", "SELECT work_id, CASE WHEN work_id = 10 THEN prev_o WHEN next_id = 10 THEN next_o ELSE o END AS new_order FROM (SELECT work_id, o, lag(o) OVER (ORDER BY o) AS prev_o, lead(o) OVER (ORDER BY o) AS next_o, lead(work_id) OVER (ORDER BY o) AS next_id FROM (SELECT work_id, row_number() OVER (ORDER BY featured_order, work_id) AS o FROM works WHERE featured OR work_id = 10) x) t")
plain("append_order", "SELECT w.work_id, m.top + row_number() OVER (ORDER BY w.work_id) AS new_order, greatest(m.id, 900000) + 1 AS next_id FROM works w JOIN (SELECT max(featured_order) AS top, max(work_id) AS id FROM works WHERE featured) m ON true WHERE NOT featured".replace("JOIN (SELECT", "CROSS JOIN (SELECT").replace(" m ON true", " m"))
plain("renumber", "SELECT work_id, o, CASE WHEN o <= 10 THEN 'a' ELSE 'b' END AS section FROM (SELECT work_id, row_number() OVER (ORDER BY title, work_id) AS o FROM works WHERE featured) t")
plain("volume_clash", "SELECT book_id FROM (SELECT book_id, count(*) OVER (PARTITION BY work_id, author_id, volume) AS n FROM books) t WHERE n > 1")
plain("limit_has_more", "SELECT work_id, n > 20 AS has_more FROM (SELECT work_id, count(*) OVER () AS n, row_number() OVER (ORDER BY work_id) AS r FROM (SELECT work_id FROM works WHERE featured ORDER BY work_id LIMIT 21) a) b WHERE r <= 20")
plain("keyset_page", "SELECT conv_id, turn, role FROM conversations WHERE conv_id > 20 OR (conv_id = 20 AND turn > 1) ORDER BY conv_id, turn LIMIT 30")
plain("topk", "SELECT book_id, bytes FROM books WHERE published ORDER BY bytes DESC, book_id LIMIT 25")
plain("join_anti", "SELECT work_id FROM works w WHERE NOT EXISTS (SELECT 1 FROM books b WHERE b.work_id = w.work_id AND volume = 6)")
plain("join_composite", "SELECT a.book, a.sequence, b.doc_id FROM pages_of a JOIN pages_of b ON a.book = b.book AND a.sequence = b.sequence - 1")

# Aggregates and sets
plain("agg_basic", "SELECT work_id, count(*) AS n, coalesce(sum(CASE WHEN published THEN bytes END), 0) AS size FROM books GROUP BY work_id")
plain("agg_distinct", "SELECT author_id, count(DISTINCT work_id) AS works, count(DISTINCT language) AS languages FROM books GROUP BY author_id")
plain("agg_filter", "SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'error') AS errors, count(*) AS n FROM events GROUP BY user_id")
QUERIES["agg_ordered"] = lambda d: f"{base(d)} SELECT author_id, {d.agg('book_id', 'volume, book_id', ';')} AS books FROM books WHERE published GROUP BY author_id"
QUERIES["agg_count_min"] = lambda d: f"SELECT user_id, count(*) AS n, min({d.micros('ts')}) AS oldest FROM events WHERE event_type = 'signup' GROUP BY user_id"
plain("fingerprint_diff", "SELECT a.book, a.n FROM (SELECT book, count(*) AS n, min(sequence) AS lo, max(sequence) AS hi FROM pages_of GROUP BY book) a LEFT JOIN (SELECT book, count(*) AS n, min(sequence) AS lo, max(sequence) AS hi FROM pages_of WHERE lang <> 'fr' GROUP BY book) b ON b.book = a.book WHERE a.n IS DISTINCT FROM b.n OR a.lo IS DISTINCT FROM b.lo OR a.hi IS DISTINCT FROM b.hi")
plain("set_union", "SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
plain("set_union_all", "SELECT k, count(*) AS n FROM (SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer) t GROUP BY k")
plain("set_intersect", "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
plain("set_except", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")

# Windows
plain("block_offsets", "SELECT conv_id, turn, coalesce(sum(CAST(length(text) AS BIGINT) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM conversations")
plain("dedup_first", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) t WHERE r = 1")
plain("running_max", "SELECT user_id, event_id, max(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS top FROM events")

# Changes
plain("version_vector", "SELECT s.subject, greatest(coalesce(stamp, 0), coalesce(change, 0)) AS version, coalesce(n, 0) AS books FROM (SELECT subject, max(featured_order) AS stamp FROM works GROUP BY subject) s LEFT JOIN (SELECT subject, max(l_orderkey) AS change, count(*) FILTER (WHERE published) AS n FROM books JOIN works USING (work_id) GROUP BY subject) b ON b.subject = s.subject")
QUERIES["feed_reset"] = lambda d: f"SELECT c AS cursor_text, TRY_CAST(c AS BIGINT) IS NULL OR TRY_CAST(c AS BIGINT) < 10 OR TRY_CAST(c AS BIGINT) > (SELECT max(event_id) FROM events) AS reset FROM (SELECT '5' AS c UNION ALL SELECT 'x' UNION ALL SELECT '200' UNION ALL SELECT '99999999' UNION ALL SELECT NULL) t"
QUERIES["tombstone_purge"] = lambda d: f"SELECT e.user_id, max(e.event_id) AS floor_seq FROM events e WHERE e.ts < (SELECT max(ts) FROM events) - INTERVAL 5 DAY AND NOT EXISTS (SELECT 1 FROM events p WHERE p.user_id = e.user_id AND p.event_type = 'purchase') GROUP BY e.user_id"
plain("sync_pull", "SELECT event_id, user_id, event_type FROM events WHERE user_id = 5 AND event_id > 100 ORDER BY event_id LIMIT 51")
QUERIES["lww_content"] = lambda d: f"SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id % 3 DESC, event_id DESC) AS r FROM events) t WHERE r = 1"
plain("upsert_merge", "SELECT coalesce(t.work_id, s.work_id) AS work_id, coalesce(s.title, t.title) AS title, t.featured_order, CASE WHEN s.work_id IS NOT NULL AND t.work_id IS NOT NULL THEN 2 ELSE 1 END AS version FROM works t FULL OUTER JOIN (SELECT work_id + 50 AS work_id, upper(title) AS title FROM works) s ON s.work_id = t.work_id")
plain("replace_children", "SELECT book, sequence, 'old' AS origin FROM pages_of WHERE book NOT IN ('src1', 'src2') UNION ALL SELECT book, sequence, 'new' FROM pages_of WHERE book IN ('src1', 'src2') AND lang = 'en'")
QUERIES["etl_skip_unchanged"] = lambda d: f"SELECT a.doc_id, CASE WHEN b.sha = {d.sha256('a.text')} THEN 'skipped' ELSE 'ok' END AS status FROM documents a LEFT JOIN (SELECT doc_id, {d.sha256('text')} AS sha FROM documents WHERE lang = 'en') b ON b.doc_id = a.doc_id"
QUERIES["etl_content_hash"] = lambda d: f"SELECT doc_id, {d.sha256('text')} AS sha FROM documents"
plain("reindex_plan", "SELECT a.book, CASE WHEN b.book IS NULL THEN 'missing' WHEN a.n <> b.n THEN 'stale' ELSE 'fresh' END AS state FROM (SELECT book, count(*) AS n FROM pages_of GROUP BY book) a LEFT JOIN (SELECT book, count(*) AS n FROM pages_of WHERE book <> 'src3' AND NOT (book = 'src4' AND sequence = 1) GROUP BY book) b ON b.book = a.book")
plain("set_patch", "SELECT DISTINCT work_id FROM (SELECT work_id FROM works WHERE work_id <= 60 AND work_id NOT IN (5, 9) UNION ALL SELECT work_id FROM works WHERE work_id IN (70, 71, 4)) t")
plain("version_scan", "SELECT a.work_id, CASE WHEN b.work_id IS NULL THEN 'new' WHEN a.n > b.n THEN 'updated' END AS kind FROM (SELECT work_id, count(*) AS n FROM books WHERE published GROUP BY work_id) a LEFT JOIN (SELECT work_id, count(*) AS n FROM books WHERE published AND volume < 5 GROUP BY work_id) b ON b.work_id = a.work_id WHERE b.work_id IS NULL OR a.n > b.n")
plain("purge_blank", "SELECT conv_id, turn, CASE WHEN conv_id < 50 THEN '' ELSE text END AS text FROM conversations WHERE role <> 'system'")

# Limits
QUERIES["rate_trailing"] = lambda d: f"SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS n FROM (SELECT event_id, user_id, {d.micros('ts')} AS us FROM events) t"
QUERIES["outbox_step"] = lambda d: f"SELECT event_id, CASE WHEN attempts >= 4 THEN 'failed' WHEN event_type = 'error' THEN 'pending' ELSE 'sent' END AS status, CASE WHEN event_type = 'error' AND attempts < 4 THEN us + CASE attempts WHEN 1 THEN 60 WHEN 2 THEN 300 ELSE 1800 END * 1000000 END AS send_after FROM (SELECT event_id, event_type, event_id % 5 AS attempts, {d.micros('ts')} AS us FROM events ORDER BY event_id LIMIT 100) t"
QUERIES["daily_cap"] = lambda d: f"SELECT event_id, CASE WHEN n > 3 THEN us + 21600000000 ELSE us END AS send_at FROM (SELECT event_id, us, count(*) OVER (PARTITION BY user_id ORDER BY us RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW) AS n FROM (SELECT event_id, user_id, {d.micros('ts')} AS us FROM events WHERE event_type <> 'view') t) x"
plain("dedupe_key", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type")

# ETL
plain("page_islands", "SELECT book, island, min(sequence) AS first, count(*) AS n FROM (SELECT book, sequence, sum(changed) OVER (PARTITION BY book ORDER BY sequence) AS island FROM (SELECT book, sequence, CASE WHEN lang IS DISTINCT FROM lag(lang) OVER (PARTITION BY book ORDER BY sequence) THEN 1 ELSE 0 END AS changed FROM pages_of) a) b GROUP BY book, island")
plain("front_split", "SELECT book, coalesce(min(CASE WHEN n < top THEN sequence END), 0) AS split FROM (SELECT book, sequence, n, max(n) OVER (PARTITION BY book ORDER BY sequence ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (SELECT book, sequence, doc_id * 37 % 101 AS n FROM pages_of) a) b GROUP BY book")
QUERIES["repeated_lines"] = lambda d: f"SELECT w AS line, count(DISTINCT doc_id) AS docs FROM {d.explode(('split(text, ' + chr(39) + chr(92) + 'n' + chr(39) + ')') if d is Spark else 'string_split(text, chr(10))', 'documents')} WHERE length(w) > 0 GROUP BY w HAVING count(DISTINCT doc_id) >= 2"
QUERIES["ngram_anchors"] = lambda d: f"""WITH g AS (SELECT doc_id, i, w, lead(w, 1) OVER (PARTITION BY doc_id ORDER BY i) AS w2, lead(w, 2) OVER (PARTITION BY doc_id ORDER BY i) AS w3, lead(w, 3) OVER (PARTITION BY doc_id ORDER BY i) AS w4 FROM (SELECT doc_id, i, w FROM {d.explode(d.words('text'), 'documents')}) a),
b AS (SELECT item_id, i, w, lead(w, 1) OVER (PARTITION BY item_id ORDER BY i) AS w2, lead(w, 2) OVER (PARTITION BY item_id ORDER BY i) AS w3, lead(w, 3) OVER (PARTITION BY item_id ORDER BY i) AS w4 FROM (SELECT item_id, i, w FROM {d.explode(d.words('text'), 'benchmark')}) a),
bk AS (SELECT concat_ws(' ', w, w2, w3, w4) AS k, min(item_id) AS item_id, min(i) AS i FROM b WHERE w4 IS NOT NULL GROUP BY 1 HAVING count(*) = 1),
gk AS (SELECT concat_ws(' ', w, w2, w3, w4) AS k, min(doc_id) AS doc_id, min(i) AS i FROM g WHERE w4 IS NOT NULL GROUP BY 1 HAVING count(*) = 1)
SELECT bk.item_id, CAST(bk.i AS BIGINT) AS item_at, gk.doc_id, CAST(gk.i AS BIGINT) AS doc_at FROM bk JOIN gk ON bk.k = gk.k"""

# Chat retrieval
plain("history_lastk", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations WHERE length(trim(text)) > 0) t WHERE r <= 6")
QUERIES["context_text"] = lambda d: f"SELECT conv_id, {d.agg(chr(39) + '[' + chr(39) + ' || role || ' + chr(39) + '] ' + chr(39) + ' || text', 'turn', '|')} AS context FROM conversations GROUP BY conv_id"
plain("usage_rollup", "SELECT role, count(*) AS n, sum(CAST(length(text) AS BIGINT)) AS chars FROM conversations GROUP BY role")
plain("meaning_filter", "SELECT vec_id FROM embeddings WHERE label IN (1, 2) AND vec_id IN (SELECT vec_id FROM embeddings WHERE vec_id < 200)")

# Search over pages
QUERIES["page_text"] = lambda d: f"SELECT conv_id, {d.agg('text', 'turn', ' / ')} AS text FROM conversations GROUP BY conv_id"
