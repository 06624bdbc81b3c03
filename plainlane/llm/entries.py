"""The training-data queries by name, and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import byte_bpe, collocations, decontaminate, line_dedup, minhash_dedup, secret_scan, sharding, source_mixing, substring_dedup, token_counts, toxicity, transport_stream, vector_codes

QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_minhash": minhash_dedup.op1_minhash,
    "op2_byte_bpe": byte_bpe.op2_byte_bpe,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_decontaminate": decontaminate.op5_decontaminate,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_sharding": sharding.op7_sharding,
    "op8_secrets": secret_scan.op8_secrets,
    "op9_substring": substring_dedup.op9_substring,
    "op10_transport_stream": transport_stream.op10_transport_stream,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_collocations": collocations.op12_collocations,
    "op13_source_mixing": source_mixing.op13_source_mixing,
}

SQL = {
    "op8_secrets": secret_scan.sql(),
    "op4_line_dedup": line_dedup.SQL,
    "op9_substring": substring_dedup.SQL,
    "op5_decontaminate": decontaminate.SQL,
    "op7_sharding": sharding.SQL,
    "op11_vector_codes": vector_codes.SQL,
    "op12_collocations": collocations.SQL,
    "op13_source_mixing": source_mixing.SQL,
}

if corpus_pipeline.ORACLE_SQL:
    SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
