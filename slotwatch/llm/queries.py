"""The corpus operators' queries and their expected SQL."""

from __future__ import annotations

from slotwatch.llm.chat import OP10_SQL, op10_chat_windows
from slotwatch.llm.decontaminate import op9_decontaminate
from slotwatch.llm.html_text import op3_html_text
from slotwatch.llm.lattice_lm import op5_lattice_lm
from slotwatch.llm.merkle import op7_merkle
from slotwatch.llm.mixing import OP1_SQL, op1_pareto_mix
from slotwatch.llm.near_dups import op8_near_dups
from slotwatch.llm.pii import op2_pii_spans
from slotwatch.llm.prefix_trie import OP13_SQL, op13_prefix_trie
from slotwatch.llm.secrets_crf import op12_secrets_crf
from slotwatch.llm.token_alignment import op11_token_alignment
from slotwatch.llm.toxicity import op6_toxicity
from slotwatch.llm.warc import OP4_SQL, op4_warc_index

QUERIES = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_pii_spans": op2_pii_spans,
    "op3_html_text": op3_html_text,
    "op4_warc_index": op4_warc_index,
    "op5_lattice_lm": op5_lattice_lm,
    "op6_toxicity": op6_toxicity,
    "op7_merkle": op7_merkle,
    "op8_near_dups": op8_near_dups,
    "op9_decontaminate": op9_decontaminate,
    "op10_chat_windows": op10_chat_windows,
    "op11_token_alignment": op11_token_alignment,
    "op12_secrets_crf": op12_secrets_crf,
    "op13_prefix_trie": op13_prefix_trie,
}
ORACLE_SQL = {
    "op1_pareto_mix": OP1_SQL,
    "op4_warc_index": OP4_SQL,
    "op10_chat_windows": OP10_SQL,
    "op13_prefix_trie": OP13_SQL,
}
