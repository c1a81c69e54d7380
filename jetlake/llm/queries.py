"""The registered queries of this subpackage, by name."""

import corpus_pipeline
from jetlake.llm import (
    centroid_clustering, chat_format, decontamination, exact_dedup, html_extract, merkle_manifest, minhash_dedup, pii,
    sentencepiece_codec, substring_dedup, token_counts, toxicity, url_filters)
from jetlake.llm.sql import ORACLES

QUERIES = {
    "op1_minhash_dedup": minhash_dedup.query,
    "op2_sentencepiece": sentencepiece_codec.query,
    "op3_substring_dedup": substring_dedup.query,
    "op4_exact_dedup": exact_dedup.query,
    "op5_pii": pii.query,
    "op6_toxicity": toxicity.query,
    "op7_chat_format": chat_format.query,
    "op8_decontamination": decontamination.query,
    "op9_token_counts": token_counts.query,
    "op10_html_extraction": html_extract.query,
    "op11_centroid_clustering": centroid_clustering.query,
    "op12_merkle_manifest": merkle_manifest.query,
    "op13_url_filters": url_filters.query,
    "pipeline": corpus_pipeline.query,
}


def oracle_sql() -> dict[str, str]:
    found = dict(ORACLES)
    if corpus_pipeline.ORACLE_SQL is not None:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return {name: sql for name, sql in found.items() if name in QUERIES}
