"""The registered queries of the training-data operators."""

from kadastra.llm import bpe, decontamination, exact_dedup, fim, html_extraction, language_id, mixing, periodic_runs, pipeline, quality, sharding, simhash, substring_dedup, toxicity

QUERIES = {
    "op1_decontamination": decontamination.op1_decontamination,
    "op2_html_extraction": html_extraction.op2_html_extraction,
    "op3_quality": quality.op3_quality,
    "op4_mixing": mixing.op4_mixing,
    "op5_sharding": sharding.op5_sharding,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_language_id": language_id.op7_language_id,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_simhash": simhash.op9_simhash,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_fim": fim.op11_fim,
    "op12_bpe": bpe.op12_bpe,
    "op13_periodic_runs": periodic_runs.op13_periodic_runs,
    "pipeline": pipeline.run,
}

ORACLE_SQL = {
    "op8_exact_dedup": exact_dedup.ORACLE,
    "op11_fim": fim.ORACLE,
}
