"""The queries of this subpackage, and the SQL that some of them equal."""

from __future__ import annotations

from furlong.llm import align, bpe, chat, decontaminate, fingerprint, idfiles, jaccard, katz, language, quality, sharding, substring, trie

QUERIES = {
    f.__name__: f
    for f in (
        jaccard.op1_ngram_jaccard, language.op2_language_id, quality.op3_quality, substring.op4_substring_dedup, katz.op5_katz_lm,
        chat.op6_chat_format, bpe.op7_byte_bpe, sharding.op8_sharding, decontaminate.op9_decontaminate, fingerprint.op10_fingerprint,
        align.op11_token_alignment, idfiles.op12_token_files, trie.op13_prefix_trie,
    )
}

ORACLE_SQL = {
    "op1_ngram_jaccard": jaccard.OP1_SQL,
    "op4_substring_dedup": substring.OP4_SQL,
    "op6_chat_format": chat.OP6_SQL,
    "op9_decontaminate": decontaminate.OP9_SQL,
    "op13_prefix_trie": trie.OP13_SQL,
}
