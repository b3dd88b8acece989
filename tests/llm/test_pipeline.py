import math
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from folioscope.llm import jaccard, mixing, near_lines, queries, toxicity

from .conftest import prose
from .test_duplicates import brute_classes


def test_stages_are_in_order():
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "n-gram Jaccard join", "mixing", "packing"]


def near_copies(first):
    """Four groups of three texts of one line that differ in two words or more, which the line stage leaves to the next one."""
    out = []
    for g in range(4):
        base = prose(700 + g, 130).split()
        for k in range(3):
            w = list(base)
            for at in ((), (20, 90), (50, 110))[k]:
                w[at] = f"other{g}{k}{at}"
            out.append((first + 3 * g + k, " ".join(w), "en", f"src{g + 1}", 0))
    return out


@pytest.fixture
def planted(spark, tmp_path):
    """The folder of tables that have documents of a size, with near copies among them."""

    def run(sf):
        docs = spark.read.parquet(f"{sf}/documents.parquet")
        own = tmp_path / "tables"
        docs.unionByName(spark.createDataFrame(near_copies(10**6), docs.schema)).repartition(4).write.parquet(str(own / "documents.parquet"))
        spark.read.parquet(f"{sf}/labels.parquet").write.parquet(str(own / "labels.parquet"))
        return str(own)

    return run


def test_stages_take_effect(spark, tmp_path, planted):
    sf = planted("/root/testdata/sf0.01")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    toxic = {r.doc_id for r in toxicity.score_documents(docs, model).filter("toxic").collect()}
    counts = [docs.count()]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        counts.append(docs.count())
        if name != "packing":
            assert docs.columns == columns
        if name == "toxicity":
            assert toxic and {r.doc_id for r in docs.collect()} == {r.doc_id for r in before.collect()} - toxic
        if name == "n-gram Jaccard join":
            classes = Counter(r.class_id for r in jaccard.classes(before).collect())
            assert counts[-1] == len(classes) and set(classes) == {r.doc_id for r in docs.collect()}
            assert sum(r.doc_id >= 10**6 for r in docs.collect()) == 4
            assert max(Counter(r.class_id for r in jaccard.classes(docs).collect()).values()) == 1
        if name == "mixing":
            assert max(Counter(r.doc_id for r in docs.collect()).values()) == 2
    assert counts[1] < counts[0] and counts[3] < counts[2]


def test_empty_documents(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() == 0


def severity(model, text):
    words = set(re.findall(r"[^\W\d_]+", (text or "").lower()))
    names = words | {w[:n] + "*" for w in words for n in (4, 5) if len(w) > n}
    z = sum(model.weights[i] for f, i in model.vocabulary.items() if f in names)
    return sum(1 / (1 + math.exp(t - z)) for t in model.thetas)


def lines_left(rows):
    """(id, text) after repeats of lines, and lines of 8 words or more within one edit of an earlier one, are gone."""
    seen, by_length, out = set(), defaultdict(list), []

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) <= 1
        a, b = sorted((a, b), key=len)
        k = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
        return a[k:] == b[k + 1 :]

    for d, text in sorted(rows, key=lambda r: r[0]):
        kept, had = [], False
        for line in text.split("\n"):
            w = tuple(line.lower().split())
            had = had or bool(w)
            if not w:
                kept.append(line)
                continue
            close = len(w) >= near_lines.MIN_WORDS and any(near(w, x) for n in (-1, 0, 1) for x in by_length[len(w) + n] if len(x) >= near_lines.MIN_WORDS)
            if w not in seen and not close:
                kept.append(line)
            if w not in seen:
                seen.add(w)
                by_length[len(w)].append(w)
        if not had or any(line.split() for line in kept):
            out.append((d, "\n".join(kept)))
    return out


def test_pipeline_against_brute_force(spark, planted):
    from tokenizers import Tokenizer

    sf = planted("/root/testdata/sf0.001")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    left = lines_left([(d, r.text) for d, r in rows.items() if severity(model, r.text) < toxicity.CUT])
    assert len(left) < len(rows)
    least, _ = brute_classes([t for _, t in left])
    documents = [(d, t) for i, (d, t) in enumerate(left) if least[i] == i]
    assert len(documents) <= len(left) - 8
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", [(d, t, rows[d].source) for d, t in documents])
    copies = {d: round(taken / size) for d, size, _, _, taken in db.sql(mixing.SQL).fetchall() if size}
    t = Tokenizer.from_file(queries.tokenizer_path())
    ids = {d: np.array([*t.encode(x, add_special_tokens=False).ids, 1], dtype="<u4") for d, x in documents}
    taken = Counter()
    for p in corpus_pipeline.run(spark, sf).collect():
        own = ids[p.doc_id]
        assert p.doc_tokens == len(own) and p.ids_crc32 == zlib.crc32(own[p.start : p.start + p.length].tobytes())
        taken[p.doc_id] += p.length
    assert taken == Counter({d: n * len(ids[d]) for d, n in copies.items() if n})


def test_awkward_documents(spark, sf, make, awkward, tmp_path):
    docs = make(awkward)
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert docs.count() and (name == "packing" or docs.columns == columns)
    # the longest text is there whole
    assert max(r.doc_tokens for r in docs.filter("doc_id = 6").collect()) > 30000
