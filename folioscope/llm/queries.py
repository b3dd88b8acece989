"""The queries of this package, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import exact_dedup, jaccard, line_rules, mixing, near_lines, packing, pii, suffixes, toxicity, warc
from .common import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(packing.VOCABULARY)


def op1_ordinal_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_line_frequency(spark, sf_dir):
    return line_rules.line_frequency(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard(spark, sf_dir):
    return jaccard.classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "text_id")


def op4_ordered_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_revisit_resolution(spark, sf_dir):
    return warc.revisit_report(table(spark, sf_dir, "pages"))


def op6_weak_pii(spark, sf_dir):
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark, sf_dir):
    return near_lines.line_report(table(spark, sf_dir, "documents"))


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op9_systematic_mix(spark, sf_dir):
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


def op10_suffix_dedup(spark, sf_dir):
    return suffixes.dedup_substrings(table(spark, sf_dir, "documents")).drop("kept")


QUERIES = {f.__name__: f for f in (op1_ordinal_toxicity, op2_line_frequency, op3_ngram_jaccard, op4_ordered_packing, op5_revisit_resolution, op6_weak_pii, op7_line_dedup, op8_exact_dedup, op9_systematic_mix, op10_suffix_dedup)}
SQL = {"op2_line_frequency": line_rules.SQL, "op5_revisit_resolution": warc.SQL, "op7_line_dedup": near_lines.SQL, "op8_exact_dedup": exact_dedup.SQL, "op9_systematic_mix": mixing.SQL}
