"""The queries of this subpackage by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from concordat.llm import ann, bpe, html_text, lines, neardup, packing, spelling, suffix_dedup, topk, toxicity, url_filter, warc, whitening

QUERIES = {
    "op1_exact_topk": topk.op1_exact_topk,
    "op2_byte_bpe": bpe.op2_byte_bpe,
    "op3_ann": ann.op3_ann,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_warc": warc.op5_warc,
    "op6_html_text": html_text.op6_html_text,
    "op7_minhash_near_dedup": neardup.op7_minhash_near_dedup,
    "op8_suffix_array_dedup": suffix_dedup.op8_suffix_array_dedup,
    "op9_line_dedup": lines.op9_line_dedup,
    "whole_line_dedup": lines.whole_line_dedup,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_url_filter": url_filter.op12_url_filter,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}
ORACLES = {"op1_exact_topk": topk.OP1_SQL, "op5_warc": warc.OP5_SQL, "op9_line_dedup": lines.OP9_SQL, "whole_line_dedup": lines.WHOLE_SQL, "op12_url_filter": url_filter.OP12_SQL}
