"""Registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from sigsight.llm import lexical, spelling, substrings
from sigsight.llm.decontamination import op6_benchmark_decontamination
from sigsight.llm.fingerprints import op1_document_fingerprints
from sigsight.llm.html import op3_html_extraction
from sigsight.llm.langid import op10_language_id
from sigsight.llm.packing import op8_packing
from sigsight.llm.quality import op9_quality_classifier
from sigsight.llm.secrets import op4_secret_scan
from sigsight.llm.simhash import op7_simhash_near_dups
from sigsight.llm.suffix_dedup import op2_suffix_dedup
from sigsight.llm.warc import op5_warc_revisits

QUERIES = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_suffix_dedup": op2_suffix_dedup,
    "op3_html_extraction": op3_html_extraction,
    "op4_secret_scan": op4_secret_scan,
    "op5_warc_revisits": op5_warc_revisits,
    "op6_benchmark_decontamination": op6_benchmark_decontamination,
    "op7_simhash_near_dups": op7_simhash_near_dups,
    "op8_packing": op8_packing,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_language_id": op10_language_id,
    "op11_substring_dedup": substrings.op11_substring_dedup,
    "op12_ranked_lexical_search": lexical.op12_ranked_lexical_search,
    "op13_spelling_variants": spelling.op13_spelling_variants,
}

#: The others need trained models, automata, hashes or tokenizers that SQL lacks,
#: or are too slow in SQL on whole tables.
ORACLES: dict[str, str] = {
    "op11_substring_dedup": substrings.ORACLE_SQL,
    "op12_ranked_lexical_search": lexical.ORACLE_SQL,
}
