"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from tallyframe.llm.chat_format import OP6_SQL, op6_chat_format
from tallyframe.llm.decontaminate import OP2_SQL, op2_decontaminate
from tallyframe.llm.filter_audit import OP12_SQL, op12_filter_audit
from tallyframe.llm.flac import op8_flac
from tallyframe.llm.maxent_lm import op9_maxent_lm
from tallyframe.llm.mixing import op13_pivotal_mix
from tallyframe.llm.near_dup import op1_order_minhash
from tallyframe.llm.quality import op5_quality
from tallyframe.llm.sentencepiece_bpe import op4_sentencepiece
from tallyframe.llm.substring_dedup import OP7_SQL, op7_substring_dedup
from tallyframe.llm.token_alignment import op11_token_alignment
from tallyframe.llm.toxicity import op10_toxicity
from tallyframe.llm.warc import OP3_SQL, op3_warc

QUERIES = {
    "op1_order_minhash": op1_order_minhash,
    "op2_decontaminate": op2_decontaminate,
    "op3_warc": op3_warc,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_quality": op5_quality,
    "op6_chat_format": op6_chat_format,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_flac": op8_flac,
    "op9_maxent_lm": op9_maxent_lm,
    "op10_toxicity": op10_toxicity,
    "op11_token_alignment": op11_token_alignment,
    "op12_filter_audit": op12_filter_audit,
    "op13_pivotal_mix": op13_pivotal_mix,
}

SQL: dict[str, str] = {
    "op2_decontaminate": OP2_SQL,
    "op3_warc": OP3_SQL,
    "op6_chat_format": OP6_SQL,
    "op7_substring_dedup": OP7_SQL,
    "op12_filter_audit": OP12_SQL,
}
