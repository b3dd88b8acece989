import re
from collections import defaultdict

from folioscope.operators import postings, search


def brute(rows, fold=lambda w: w):
    out = defaultdict(list)
    for d, t in rows:
        for i, w in enumerate(re.findall(r"[^\W_]+", (t or "").lower())):
            out[fold(w), d].append(i)
    return out


CASES = [(1, "The cat, the HAT: été ete the"), (2, None), (3, ""), (4, " ... "), (5, "zebra_crossing 12 a1 zebra"), (6, "thé the Thê tete tété"), (None, "the end")]


def held(frame):
    rows = [((r.term, r.doc_id), r.positions) for r in frame.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def test_postings_hold_every_term_and_place(spark, sf):
    made = spark.createDataFrame(CASES, "doc_id long, text string")
    assert held(postings.postings(postings.page_index(made))) == brute(CASES)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got, want = held(postings.postings(postings.page_index(docs))), brute(rows)
    assert got == want and any(len(x) > 1 for x in want.values())
    assert postings.postings(postings.page_index(made.limit(0))).collect() == []


def test_fold_merges_the_positions_of_equal_terms(spark, sf):
    fold = lambda w: w.translate(str.maketrans("éèê", "eee"))
    made = spark.createDataFrame(CASES, "doc_id long, text string")
    got = held(postings.postings(postings.fold_index(postings.page_index(made))))
    assert got == brute(CASES, fold) and got["the", 6] == [0, 1, 2] and got["tete", 6] == [3, 4]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = held(postings.postings(postings.fold_index(postings.page_index(docs))))
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()], fold)


def test_phrases_on_a_stored_index(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    postings.stored(postings.postings(postings.page_index(docs)), str(tmp_path / "i"))
    index = spark.read.parquet(str(tmp_path / "i"))
    line = search.indexed(docs)
    for item in spark.read.parquet(f"{sf}/benchmark.parquet").limit(12).collect():
        phrase = " ".join(item.text.split()[3:6])
        want = {r.doc_id: r.n for r in search.phrase_pages(line, phrase).select("doc_id", search.occurrences(line["line"], phrase).alias("n")).collect()}
        assert {r.doc_id: r.n for r in search.postings_phrase(index, phrase).collect()} == want
    # a word that comes twice, and a phrase that overlaps itself
    own = search.indexed(spark.createDataFrame([(1, "a a a b"), (2, "a b a"), (3, "")], "doc_id long, text string"))
    made = postings.postings(postings.page_index(own.select("doc_id", "text")))
    for phrase in ("a a", "a b a", "b", "a b"):
        want = {r.doc_id: r.n for r in search.phrase_pages(own, phrase).select("doc_id", search.occurrences(own["line"], phrase).alias("n")).collect()}
        assert {r.doc_id: r.n for r in search.postings_phrase(made, phrase).collect()} == want, phrase
