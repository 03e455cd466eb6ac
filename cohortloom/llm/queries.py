"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from . import op01_backoff, op02_toxicity, op03_bpe, op04_pii, op05_langid, op06_substring, op07_warc, op08_exact, op09_minmax, op10_decontaminate

_ALL = {
    "op1_stupid_backoff": op01_backoff,
    "op2_toxicity": op02_toxicity,
    "op3_byte_bpe": op03_bpe,
    "op4_pii": op04_pii,
    "op5_language_id": op05_langid,
    "op6_substring_dedup": op06_substring,
    "op7_warc_salvage": op07_warc,
    "op8_exact_dedup": op08_exact,
    "op9_minmax_near_dedup": op09_minmax,
    "op10_decontamination": op10_decontaminate,
}

QUERIES = {name: module.query for name, module in _ALL.items()}
ORACLE_SQL = {name: module.SQL for name, module in _ALL.items() if hasattr(module, "SQL")}
