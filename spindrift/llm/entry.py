"""Queries of the text operators, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import corpus_pipeline
from spindrift.llm import bpe, exact_dedup, fingerprint, hmm_lm, neardup, packing, pii, secrets, toxicity, warc

QUERIES = {
    "op1_fingerprint": fingerprint.op1_fingerprint,
    "op2_packing": packing.op2_packing,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_pii": pii.op4_pii,
    "op5_hmm_lm": hmm_lm.op5_hmm_lm,
    "op6_bpe": bpe.op6_bpe,
    "op7_near_dedup": neardup.op7_near_dedup,
    "op8_warc": warc.op8_warc,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_secrets": secrets.op10_secrets,
    "pipeline": corpus_pipeline.run,
}

ORACLES = {"op3_exact_dedup": exact_dedup.ORACLE_SQL, "op7_near_dedup": neardup.ORACLE_SQL, "op8_warc": warc.ORACLE_SQL}
