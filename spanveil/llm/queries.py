"""The queries of this subpackage, and DuckDB SQL for those that SQL can express.

The others are tested against brute force, an exact round trip, or held-out accuracy in tests/llm.
"""

from __future__ import annotations

from spanveil.llm import (
    conversation_trie,
    decontaminate,
    host_reputation,
    html_extract,
    language_id,
    lexical_search,
    license_scan,
    packing,
    pii_crf,
    quality_classifier,
    quality_rules,
    secret_scan,
    simhash_dedup,
)

QUERIES = {
    "op1_secret_scan": secret_scan.op1_secret_scan,
    "op2_simhash_dedup": simhash_dedup.op2_simhash_dedup,
    "op3_host_reputation": host_reputation.op3_host_reputation,
    "op4_packing": packing.op4_packing,
    "op5_language_id": language_id.op5_language_id,
    "op6_decontamination": decontaminate.op6_decontamination,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_license_scan": license_scan.op9_license_scan,
    "op10_html_extract": html_extract.op10_html_extract,
    "op11_conversation_trie": conversation_trie.op11_conversation_trie,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_pii": pii_crf.op13_pii,
}

ORACLE_SQL = {
    "op3_host_reputation": host_reputation.oracle(),
    "op6_decontamination": decontaminate.ORACLE,
    "op9_license_scan": license_scan.oracle(),
    "op11_conversation_trie": conversation_trie.ORACLE,
    "op12_lexical_search": lexical_search.ORACLE,
}
