"""Queries of the training-data operators and the SQL that checks them."""

from __future__ import annotations

from panelforge.llm.alignment import op11_tokenizer_alignment
from panelforge.llm.chat import OP4_SQL, op4_chat_format
from panelforge.llm.language_id import op6_language_id
from panelforge.llm.hyperminhash import op13_minhash
from panelforge.llm.lexical import OP12_SQL, op12_lexical_search
from panelforge.llm.line_dedup import op8_line_dedup
from panelforge.llm.mixing import OP5_SQL, op5_mixing
from panelforge.llm.nearest import OP3_SQL, op3_nearest
from panelforge.llm.packing import op9_packing
from panelforge.llm.quality_rules import op1_quality_rules
from panelforge.llm.quality_trees import op10_quality_trees
from panelforge.llm.simhash import op2_simhash
from panelforge.llm.warc import OP7_SQL, op7_warc

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_simhash, op3_nearest, op4_chat_format, op5_mixing, op6_language_id, op7_warc, op8_line_dedup, op9_packing, op10_quality_trees, op11_tokenizer_alignment, op12_lexical_search, op13_minhash)}
ORACLE_SQL: dict[str, str] = {"op3_nearest": OP3_SQL, "op4_chat_format": OP4_SQL, "op5_mixing": OP5_SQL, "op7_warc": OP7_SQL, "op12_lexical_search": OP12_SQL}
