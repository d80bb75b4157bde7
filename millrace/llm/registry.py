"""The corpus operators' queries and SQL."""

from __future__ import annotations

from collections.abc import Callable

from millrace.llm import alignment, decontam, embeddings, langid, licenses, merkle, minhash, pieces, pii, quality, secrets, tokens, toxicity

QUERIES: dict[str, Callable] = {
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_language_id": langid.op4_language_id,
    "op1_embedding_near_dedup": embeddings.op1_embedding_near_dedup,
    "op5_license_scan": licenses.op5_license_scan,
    "op6_token_counts": tokens.op6_token_counts,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op10_pii_surrogates": pii.op10_pii_surrogates,
    "op9_benchmark_decontamination": decontam.op9_benchmark_decontamination,
    "op7_minhash_near_dedup": minhash.op7_minhash_near_dedup,
    "op8_quality_classifier": quality.op8_quality_classifier,
    "op11_merkle_manifest": merkle.op11_merkle_manifest,
    "op12_token_alignment": alignment.op12_token_alignment,
    "op13_secret_scan": secrets.op13_secret_scan,
}

ORACLES: dict[str, str] = {
    "op1_embedding_near_dedup": embeddings.SQL,
    "op5_license_scan": licenses.SQL,
    "op9_benchmark_decontamination": decontam.SQL,
    "op11_merkle_manifest": merkle.SQL,
}


def queries() -> dict[str, Callable]:
    import corpus_pipeline

    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
