"""The training-data operators' queries and their SQL."""

from __future__ import annotations

import corpus_pipeline
from noticeboard.llm import codes, decontaminate, fingerprint, linededup, lm, neardup, pack, partenum, pii, quality, secrets, toxicity, whitening


def queries() -> dict:
    return {"op1_linededup": linededup.op1, "op2_decontaminate": decontaminate.op2, "op3_neardup": neardup.op3, "op4_secrets": secrets.op4, "op5_pack": pack.op5, "op6_pii": pii.op6, "op7_toxicity": toxicity.op7, "op8_fingerprint": fingerprint.op8, "op9_lm": lm.op9, "op10_quality": quality.op10, "op11_whitening": whitening.op11, "op12_partenum": partenum.op12, "op13_codes": codes.op13, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {"op2_decontaminate": decontaminate.ORACLE, "op3_neardup": neardup.ORACLE, "op12_partenum": partenum.ORACLE, "op13_codes": codes.ORACLE}
