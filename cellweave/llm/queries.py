"""The registered queries of the corpus operators and, where SQL can express them, their SQL twins."""

from __future__ import annotations

from cellweave.llm.bestfit_packing import op12_bestfit_packing
from cellweave.llm.chat_format import OP3_SQL, op3_chat_format
from cellweave.llm.decontaminate import OP9_SQL, op9_decontamination
from cellweave.llm.html_extract import op1_html_extraction
from cellweave.llm.language_id import op7_language_id
from cellweave.llm.ngram_join import op5_ngram_join
from cellweave.llm.packing import op4_packing
from cellweave.llm.periodic_runs import op13_periodic_runs
from cellweave.llm.quality_model import op2_quality_classifier
from cellweave.llm.quality_rules import OP8_SQL, op8_quality_rules
from cellweave.llm.sharding import op10_sharding
from cellweave.llm.suffix_dedup import op6_suffix_dedup
from cellweave.llm.token_alignment import op11_token_alignment

QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_chat_format": op3_chat_format,
    "op4_packing": op4_packing,
    "op5_ngram_join": op5_ngram_join,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_language_id": op7_language_id,
    "op8_quality_rules": op8_quality_rules,
    "op9_decontamination": op9_decontamination,
    "op10_sharding": op10_sharding,
    "op11_token_alignment": op11_token_alignment,
    "op12_bestfit_packing": op12_bestfit_packing,
    "op13_periodic_runs": op13_periodic_runs,
}

ORACLE_SQL = {
    "op3_chat_format": OP3_SQL,
    "op8_quality_rules": OP8_SQL,
    "op9_decontamination": OP9_SQL,
}
