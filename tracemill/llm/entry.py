"""The queries of this folder and the SQL that some of them must agree with."""

from __future__ import annotations

from tracemill.llm.byte_bpe import op10_byte_bpe
from tracemill.llm.collocations import OP13_SQL, op13_collocations
from tracemill.llm.license_scan import op1_license_scan
from tracemill.llm.interpolation import op2_lm_scoring
from tracemill.llm.chat_format import op9_chat_format
from tracemill.llm.mixing import op12_mixing
from tracemill.llm.packing import op6_best_fit_packing
from tracemill.llm.quality import op3_quality_classifier
from tracemill.llm.sessions import OP11_SQL, op11_sessions
from tracemill.llm.simhash import op4_simhash_fingerprint
from tracemill.llm.simhash_dedup import op7_simhash_dedup
from tracemill.llm.suffix_dedup import op8_suffix_dedup
from tracemill.llm.topk_hamming import OP5_SQL, op5_exact_topk


def queries():
    return {
        "op1_license_scan": op1_license_scan,
        "op2_lm_scoring": op2_lm_scoring,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_simhash_fingerprint": op4_simhash_fingerprint,
        "op5_exact_topk": op5_exact_topk,
        "op6_best_fit_packing": op6_best_fit_packing,
        "op7_simhash_dedup": op7_simhash_dedup,
        "op8_suffix_dedup": op8_suffix_dedup,
        "op9_chat_format": op9_chat_format,
        "op10_byte_bpe": op10_byte_bpe,
        "op11_sessions": op11_sessions,
        "op12_mixing": op12_mixing,
        "op13_collocations": op13_collocations,
    }


def oracle_sql():
    return {"op5_exact_topk": OP5_SQL, "op11_sessions": OP11_SQL, "op13_collocations": OP13_SQL}
