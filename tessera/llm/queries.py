"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import ann, crf, decontam, fim, fst, minhash, packing, raking, repair, styletree, suffix, tokens, warczip

QUERIES = {
    "op1_token_output": tokens.op1_token_output,
    "op2_raked_mixture": raking.op2_raked_mixture,
    "op3_suffix_dedup": suffix.op3_suffix_dedup,
    "op4_style_tree": styletree.op4_style_tree,
    "op5_minhash_tensored": minhash.op5_minhash_tensored,
    "op6_lsa_decontamination": decontam.op6_lsa_decontamination,
    "op7_crf_language": crf.op7_crf_language,
    "op8_ann": ann.op8_ann,
    "op9_warc_zip": warczip.op9_warc_zip,
    "op10_fst_token_counts": fst.op10_fst_token_counts,
    "op11_fim": fim.op11_fim,
    "op12_packing": packing.op12_packing,
    "op13_repair": repair.op13_repair,
}
ORACLES = {"op9_warc_zip": warczip.OP9_SQL, "op11_fim": fim.OP11_SQL, "op13_repair": repair.OP13_SQL}
