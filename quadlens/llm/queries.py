"""The registered query of each operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers

from quadlens.llm import alignment, html_crf, jaccard_join, knn_voronoi, lang_hd, line_dedup, packing, piece_codec, quality_rules, suffix_dedup, token_counts, vector_codes, warc
from quadlens.llm.common import table

#: Places of the public vocabularies; parameters of the operators.
PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_html_extraction(spark, sf_dir):
    return html_crf.extract(table(spark, sf_dir, "pages"))


def op2_sentencepiece(spark, sf_dir):
    return piece_codec.round_trip_report(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op3_suffix_dedup(spark, sf_dir):
    return suffix_dedup.suffix_dedup_report(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"), 4, 85)


def op5_language_id(spark, sf_dir):
    return lang_hd.language_report(table(spark, sf_dir, "documents"))


def op6_token_counts(spark, sf_dir):
    return token_counts.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE, 1024)


def op7_exact_top_k(spark, sf_dir):
    return knn_voronoi.top_k(table(spark, sf_dir, "embeddings"), 20, 20)


def op8_quality_rules(spark, sf_dir):
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


def op9_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), BYTE_BPE, 1024, ranks=BYTE_RANKS)


def op10_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup_report(table(spark, sf_dir, "documents"))


def op11_alignment(spark, sf_dir):
    return alignment.alignment_report(table(spark, sf_dir, "documents"), BYTE_BPE, PIECE_MODEL)


def op12_vector_codes(spark, sf_dir):
    return vector_codes.code_report(table(spark, sf_dir, "embeddings"))


def op13_warc(spark, sf_dir):
    return warc.archive_report(table(spark, sf_dir, "pages"))


def queries():
    first = (op1_html_extraction, op2_sentencepiece, op3_suffix_dedup, op4_jaccard_join, op5_language_id, op6_token_counts, op7_exact_top_k)
    return {f.__name__: f for f in (*first, op8_quality_rules, op9_packing, op10_line_dedup, op11_alignment, op12_vector_codes, op13_warc)}


def oracle_sql():
    return {"op7_exact_top_k": knn_voronoi.ORACLE, "op8_quality_rules": quality_rules.oracle(), "op10_line_dedup": line_dedup.ORACLE, "op12_vector_codes": vector_codes.oracle(), "op13_warc": warc.ORACLE}
