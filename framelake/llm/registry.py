"""Queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import bpe_codec, exact_dedup, hard_negatives, merkle, packing, periodic, pii, pipeline, projections, quality, simhash, token_counts, url_filter, warc

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_token_counts": token_counts.op2_token_counts,
    "op3_warc": warc.op3_warc,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_packing": packing.op6_packing,
    "op7_quality": quality.op7_quality,
    "op8_simhash": simhash.op8_simhash,
    "op9_merkle": merkle.op9_merkle,
    "op10_bpe": bpe_codec.op10_bpe,
    "op11_near_vectors": projections.op11_near_vectors,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_runs": periodic.op13_runs,
    "pipeline": pipeline.run,
}
ORACLES = {**exact_dedup.ORACLE, **warc.ORACLE, **projections.ORACLE, **hard_negatives.ORACLE}
