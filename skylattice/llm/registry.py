"""Queries of this subpackage and their SQL, by name."""

from . import decontaminate, fill_in_middle, language_id, licenses, lm_score, mixing, ngram_join, quality, sentence_pieces, sharding, substring_dedup, warc, whitening

QUERIES = {
    "op1_benchmark_decontamination": decontaminate.op1_benchmark_decontamination,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_quality_rules": quality.op3_quality_rules,
    "op4_source_mixing": mixing.op4_source_mixing,
    "op5_lm_scoring": lm_score.op5_lm_scoring,
    "op6_warc_bundles": warc.op6_warc_bundles,
    "op7_language_id": language_id.op7_language_id,
    "op8_license_scan": licenses.op8_license_scan,
    "op9_balanced_shards": sharding.op9_balanced_shards,
    "op10_ngram_jaccard_join": ngram_join.op10_ngram_jaccard_join,
    "op11_sentence_pieces": sentence_pieces.op11_sentence_pieces,
    "op12_fill_in_middle": fill_in_middle.op12_fill_in_middle,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}
ORACLES: dict[str, str] = {
    "op3_quality_rules": quality.ORACLE,
    "op1_benchmark_decontamination": decontaminate.ORACLE,
    "op2_substring_dedup": substring_dedup.ORACLE,
    "op6_warc_bundles": warc.ORACLE,
    "op8_license_scan": licenses.ORACLE,
    "op10_ngram_jaccard_join": ngram_join.ORACLE,
    "op12_fill_in_middle": fill_in_middle.ORACLE,
}
