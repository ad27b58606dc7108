"""The registered queries of this subpackage and the SQL that gives the same rows."""

from __future__ import annotations

from . import chroma, divergence, hash_forest, line_blocks, link_trust, mixing, packing, phrases, simhash_bk, suffix_dedup, tool_calls, warc, weak_quality


def queries() -> dict:
    return {
        "op1_link_trust": link_trust.op1,
        "op2_suffix_dedup": suffix_dedup.op2,
        "op3_best_fit_packing": packing.op3,
        "op4_hash_forest": hash_forest.op4,
        "op5_weak_label_quality": weak_quality.op5,
        "op6_source_mixing": mixing.op6,
        "op7_chroma_fingerprints": chroma.op7,
        "op8_warc_capture_index": warc.op8,
        "op9_simhash_bk_trees": simhash_bk.op9,
        "op10_tool_call_linking": tool_calls.op10,
        "op11_main_text": line_blocks.op11,
        "op12_phrase_collocations": phrases.op12,
        "op13_source_divergence": divergence.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_link_trust": link_trust.OP1_SQL,
        "op6_source_mixing": mixing.OP6_SQL,
        "op12_phrase_collocations": phrases.OP12_SQL,
        "op13_source_divergence": divergence.OP13_SQL,
    }
