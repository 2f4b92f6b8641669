"""Queries of this subpackage, over the whole ``documents`` table, and their SQL."""

from __future__ import annotations

from otelframe.llm import audio, bpe, conversations, exact_dedup, fill_middle, jaccard, language, lines, packing, passages, secrets, suffixes, token_store


def queries() -> dict:
    return {
        "op1_language_id": language.op1_language_id,
        "op2_bpe": bpe.op2_bpe,
        "op3_secret_scan": secrets.op3_secret_scan,
        "op4_token_store": token_store.op4_token_store,
        "op5_audio_features": audio.op5_audio_features,
        "op6_substring_dedup": passages.op6_substring_dedup,
        "op7_exact_dedup": exact_dedup.op7_exact_dedup,
        "op8_line_dedup": lines.op8_line_dedup,
        "op8_line_dedup_short": lines.op8_line_dedup_short,
        "op9_ngram_jaccard": jaccard.op9_ngram_jaccard,
        "op10_best_fit_packing": packing.op10_best_fit_packing,
        "op11_conversation_repair": conversations.op11_conversation_repair,
        "op12_suffix_dedup": suffixes.op12_suffix_dedup,
        "op13_fill_middle": fill_middle.op13_fill_middle,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_exact_dedup": exact_dedup.OP7_SQL, "op8_line_dedup": lines.OP8_SQL, "op8_line_dedup_short": lines.OP8_SHORT_SQL, "op12_suffix_dedup": suffixes.OP12_SQL, "op13_fill_middle": fill_middle.OP13_SQL}
