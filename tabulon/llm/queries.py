"""The registered queries of the training-data operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from tabulon.llm.decontaminate import OP12_SQL, op12_positional_index
from tabulon.llm.langid import op4_string_kernel_langid
from tabulon.llm.mix import OP8_SQL, op8_mix_sources
from tabulon.llm.pack import op7_pack_pow2
from tabulon.llm.passages import op1_compact_windows
from tabulon.llm.quality import op3_attention_quality
from tabulon.llm.resample import OP11_SQL, op11_importance_resampling
from tabulon.llm.rules import OP9_SQL, op9_divergence_rules
from tabulon.llm.simhash import op6_golay_simhash
from tabulon.llm.spelling import OP13_SQL, op13_bit_sliced_spelling
from tabulon.llm.suffix import op10_suffix_dedup
from tabulon.llm.topk import OP2_SQL, op2_pivot_topk
from tabulon.llm.wacz import OP5_SQL, op5_wacz

QUERIES = {
    "op1_compact_windows": op1_compact_windows,
    "op2_pivot_topk": op2_pivot_topk,
    "op3_attention_quality": op3_attention_quality,
    "op4_string_kernel_langid": op4_string_kernel_langid,
    "op5_wacz": op5_wacz,
    "op6_golay_simhash": op6_golay_simhash,
    "op7_pack_pow2": op7_pack_pow2,
    "op8_mix_sources": op8_mix_sources,
    "op9_divergence_rules": op9_divergence_rules,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_positional_index": op12_positional_index,
    "op13_bit_sliced_spelling": op13_bit_sliced_spelling,
}

ORACLE = {
    "op2_pivot_topk": OP2_SQL,
    "op5_wacz": OP5_SQL,
    "op8_mix_sources": OP8_SQL,
    "op9_divergence_rules": OP9_SQL,
    "op11_importance_resampling": OP11_SQL,
    "op12_positional_index": OP12_SQL,
    "op13_bit_sliced_spelling": OP13_SQL,
}
