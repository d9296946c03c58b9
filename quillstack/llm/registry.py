"""Queries of the corpus operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from . import decontaminate, licenses, line_dedup, mixing, near_dup, quality, quotations, rnn_lm, toxicity, url_filter

QUERIES = {
    f.__name__: f
    for f in (
        licenses.op1_license_scan, mixing.op2_mixing, decontaminate.op3_decontaminate, rnn_lm.op4_lm_score, near_dup.op5_near_dup,
        quotations.op6_quotations, quality.op7_quality, line_dedup.op8_line_dedup, toxicity.op9_toxicity, url_filter.op10_url_filter,
    )
}
SQL = {"op2_mixing": mixing.SQL, "op6_quotations": quotations.SQL, "op8_line_dedup": line_dedup.SQL}
