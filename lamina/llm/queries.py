"""The queries of the training-data operators, and DuckDB SQL for those that SQL can express."""

from lamina.llm import decontamination, language_model, lines, mixing, quality, sharding, simhash, sketches, tokens, warc

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_simhash": simhash.op3_simhash,
    "op4_mixing": mixing.op4_mixing,
    "op5_line_dedup": lines.op5_line_dedup,
    "op6_language_model": language_model.op6_language_model,
    "op7_quality": quality.op7_quality,
    "op8_warc": warc.op8_warc,
    "op9_token_counts": tokens.op9_token_counts,
    "op10_fingerprints": sketches.op10_fingerprints,
}

ORACLE_SQL = {
    "op1_sharding": sharding.ORACLE_SQL,
    "op4_mixing": mixing.ORACLE_SQL,
    "op5_line_dedup": lines.ORACLE_SQL,
    "op6_language_model": language_model.ORACLE_SQL,
    "op8_warc": warc.ORACLE_SQL,
}
