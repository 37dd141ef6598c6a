"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from echometer.llm.bpe import op7_byte_bpe
from echometer.llm.chat import OP4_SQL, op4_chat_formatting
from echometer.llm.decontaminate import op6_decontamination
from echometer.llm.filter_audit import OP11_SQL, op11_filter_audit
from echometer.llm.fingerprints import op1_fingerprints
from echometer.llm.jaccard import op3_ngram_jaccard
from echometer.llm.language import op8_language_id
from echometer.llm.lines import OP10_SQL, op10_line_dedup
from echometer.llm.periodic_runs import op13_periodic_runs
from echometer.llm.quality import op12_quality_classifier
from echometer.llm.secrets import op9_secrets
from echometer.llm.sharding import op2_sharding
from echometer.llm.tokens import op5_token_files

QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_sharding": op2_sharding,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_token_files": op5_token_files,
    "op6_decontamination": op6_decontamination,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_language_id": op8_language_id,
    "op9_secrets": op9_secrets,
    "op10_line_dedup": op10_line_dedup,
    "op11_filter_audit": op11_filter_audit,
    "op12_quality_classifier": op12_quality_classifier,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE: dict[str, str] = {
    "op4_chat_formatting": OP4_SQL,
    "op10_line_dedup": OP10_SQL,
    "op11_filter_audit": OP11_SQL,
}
