"""A corpus pipeline of five stages, each written and read again as the next one's documents.

Toxicity, line dedup, n-gram Jaccard join, mixing to target weights, packing. All but the last return the columns of
documents.
"""

from __future__ import annotations

import uuid

from folioscope.llm import common, jaccard, mixing, near_lines, packing, queries, toxicity


def toxicity_stage(spark, docs, sf_dir):
    """Documents whose expected severity reaches the cut go; the model comes from the labels of these documents."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, common.table(spark, sf_dir, "labels")))


def line_stage(spark, docs, sf_dir):
    """Lines that repeat an earlier one, or are one word off it, go from the texts."""
    return near_lines.dedup_lines(docs)


def near_stage(spark, docs, sf_dir):
    """One document of each near-duplicate class stays."""
    return jaccard.keep_one(docs)


def mixing_stage(spark, docs, sf_dir):
    """Each document as often as its source's target asks for."""
    return mixing.mixed_rows(docs)


def packing_stage(spark, docs, sf_dir):
    """Pieces of documents in sequences."""
    return packing.pack(docs, queries.tokenizer_path())


STAGES = [("toxicity", toxicity_stage), ("line dedup", line_stage), ("n-gram Jaccard join", near_stage), ("mixing", mixing_stage), ("packing", packing_stage)]
#: A trained model and a tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = common.table(spark, sf_dir, "documents")
    base = f"{common.shared_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        path = f"{base}-{k}"
        out.write.parquet(path)
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
        docs = spark.read.schema(out.schema).parquet(path)
