"""Registered queries of the subpackage and their DuckDB statements, where SQL can state them."""

from __future__ import annotations

from nightledger.llm import (
    language,
    licenses,
    mixing,
    neardup,
    negatives,
    packing,
    quality,
    sharding,
    spotsigs,
    topk,
    toxicity,
    transducer,
    whitening,
)

QUERIES = {
    "op1_exact_top_k": topk.query,
    "op2_pu_quality": quality.query,
    "op3_license_scan": licenses.query,
    "op4_weak_toxicity": toxicity.query,
    "op5_best_fit_packing": packing.query,
    "op6_bbit_minhash": neardup.query,
    "op7_rendezvous_shards": sharding.query,
    "op8_source_mix": mixing.query,
    "op9_spotsigs": spotsigs.query,
    "op10_ppm_language": language.query,
    "op11_lanczos_whitening": whitening.query,
    "op12_kronecker_negatives": negatives.query,
    "op13_bpe_transducer": transducer.query,
}

ORACLES = {
    "op1_exact_top_k": topk.SQL,
    "op6_bbit_minhash": neardup.SQL,
    "op7_rendezvous_shards": sharding.SQL,
    "op8_source_mix": mixing.SQL,
    "op12_kronecker_negatives": negatives.SQL,
}
