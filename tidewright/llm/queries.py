"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from tidewright import shipping
from tidewright.llm import ann, decontam, html_text, langid, linededup, neardup, packing, quality, toxicity, warc


def queries() -> dict:
    every = {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_robust_pruned_graph": ann.op2_robust_pruned_graph,
        "op3_nearest_url_differencing": html_text.op3_nearest_url_differencing,
        "op4_language_id": langid.op4_language_id,
        "op5_line_dedup": linededup.op5_line_dedup,
        "op6_quality_subword_embeddings": quality.op6_quality_subword_embeddings,
        "op7_toxicity_grammar": toxicity.op7_toxicity_grammar,
        "op8_pigeonhole_decontamination": decontam.op8_pigeonhole_decontamination,
        "op9_minhash_near_dedup": neardup.op9_minhash_near_dedup,
        "op10_warc_content_addressed": warc.op10_warc_content_addressed,
    }
    return {name: shipping(f) for name, f in every.items()}


def oracle_sql() -> dict:
    return {"op10_warc_content_addressed": warc.OP10_SQL}
