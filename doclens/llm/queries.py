"""The queries of this subpackage and, where SQL can express them, the same in DuckDB's SQL."""

from __future__ import annotations

from doclens.llm import bpe, chat, decontaminate, fingerprint, jaccard, langid, licenses, lm, reassembly, sharding, toxicity, trie, warc

QUERIES = {
    "op1_jaccard_join": jaccard.near_copies,
    "op2_licenses": licenses.licenses,
    "op3_sharding": sharding.shards,
    "op4_decontamination": decontaminate.leaks,
    "op5_bpe": bpe.digests,
    "op6_toxicity": toxicity.toxicity,
    "op7_fingerprints": fingerprint.fingerprints,
    "op8_warc": warc.archive,
    "op9_tool_calls": chat.linked,
    "op10_language": langid.languages,
    "op11_reassembly": reassembly.turns,
    "op12_lm_scores": lm.lm_scores,
    "op13_prefix_trie": trie.prefix_trie,
}

ORACLE_SQL = {
    "op1_jaccard_join": jaccard.SQL,
    "op2_licenses": licenses.SQL,
    "op3_sharding": sharding.SQL,
    "op8_warc": warc.SQL,
    "op9_tool_calls": chat.SQL,
    "op11_reassembly": reassembly.SQL,
    "op13_prefix_trie": trie.SQL,
}
