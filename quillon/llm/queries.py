"""The queries of this subpackage, by name, and the SQL that checks those which SQL can express."""

from __future__ import annotations

from quillon.llm import chat, decontam, exact, fixity, langid, minhash, mixing, mlm, packing, pii, spelling, suffix, yinyang


def queries() -> dict:
    return {
        "op1_merkle_fixity": fixity.op1_merkle_fixity,
        "op2_minhash_neardup": minhash.op2_minhash_neardup,
        "op3_prefix_tree_chat": chat.op3_prefix_tree_chat,
        "op4_weak_pii": pii.op4_weak_pii,
        "op5_masked_likelihood": mlm.op5_masked_likelihood,
        "op6_segmentation_langid": langid.op6_segmentation_langid,
        "op7_pareto_mix": mixing.op7_pareto_mix,
        "op8_suffix_dedup": suffix.op8_suffix_dedup,
        "op9_exact_dedup": exact.op9_exact_dedup,
        "op10_winnow_decontam": decontam.op10_winnow_decontam,
        "op11_yinyang_clusters": yinyang.op11_yinyang_clusters,
        "op12_spelling_variants": spelling.op12_spelling_variants,
        "op13_bin_completion_packing": packing.op13_bin_completion_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_merkle_fixity": fixity.SQL,
        "op2_minhash_neardup": minhash.SQL,
        "op3_prefix_tree_chat": chat.SQL,
        "op7_pareto_mix": mixing.SQL,
        "op9_exact_dedup": exact.SQL,
        "op10_winnow_decontam": decontam.SQL,
        "op11_yinyang_clusters": yinyang.SQL,
        "op12_spelling_variants": spelling.SQL,
    }
