"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import corpus_pipeline

from . import benchmark_leaks, bpe_codec, embedding_dups, forced_bpe, lm_score, minhash_dups, preference, quality, sharding, term_pipeline, token_grammar, toxicity, word_runs

QUERIES = {
    "op1_benchmark_leaks": benchmark_leaks.query,
    "op2_token_grammar": token_grammar.query,
    "op3_jump_shards": sharding.query,
    "op4_byte_bpe": bpe_codec.query,
    "op5_weak_label_quality": quality.query,
    "op6_minhash_dups": minhash_dups.query,
    "op7_embedding_dups": embedding_dups.query,
    "op8_preference_format": preference.query,
    "op8_preference_all_answered": preference.query_all,
    "op9_toxicity": toxicity.query,
    "op10_lm_score": lm_score.query,
    "op11_forced_bpe": forced_bpe.query,
    "op12_lexical_search": term_pipeline.query,
    "op13_periodic_runs": word_runs.query,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL = {
    "op3_jump_shards": sharding.ORACLE_SQL,
    "op6_minhash_dups": minhash_dups.ORACLE_SQL,
    "op7_embedding_dups": embedding_dups.ORACLE_SQL,
    "op8_preference_format": preference.ORACLE_SQL,
    "op8_preference_all_answered": preference.ORACLE_SQL,
    "op12_lexical_search": term_pipeline.ORACLE_SQL,
}
