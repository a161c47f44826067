"""A training corpus out of documents, in stages; each stage's rows are written as Parquet and read again.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept. All but the last return the
columns of documents; the last packs what is left into sequences.
"""

from __future__ import annotations

from quadlens.llm import jaccard_join, line_dedup, packing, quality_rules, suffix_dedup
from quadlens.llm.common import new_path, on_workers
from quadlens.llm.queries import BYTE_BPE, BYTE_RANKS


def quality(spark, docs, sf_dir):
    """Documents that the rules reject go."""
    return quality_rules.keep_good(docs)


def lines(spark, docs, sf_dir):
    """Lines that an earlier document has go."""
    return line_dedup.dedup_documents(docs)


def near_copies(spark, docs, sf_dir):
    """Of each group of near copies (five-word shingles, similarity of 0.8 or more) the smallest doc_id stays."""
    on_workers(spark)
    return jaccard_join.keep_one(docs, 5, 80)


def passages(spark, docs, sf_dir):
    """Passages of 50 bytes or more that an earlier document has go."""
    on_workers(spark)
    return suffix_dedup.dedup_documents(docs)


def packed(spark, docs, sf_dir):
    """Sequences of at most 1024 tokens."""
    on_workers(spark)
    return packing.pack(docs, BYTE_BPE, 1024, ranks=BYTE_RANKS)


STAGES = [("quality rules", quality), ("line dedup", lines), ("n-gram Jaccard join", near_copies), ("suffix-array dedup", passages), ("best-fit packing", packed)]

#: None: SQL cannot express tokenizing and packing; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir):
    """The packed sequences of the documents in sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            path = new_path(spark, "pipeline")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
