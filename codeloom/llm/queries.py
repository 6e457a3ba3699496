"""Registered queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from codeloom.llm.embedding_dedup import op5_embedding_dedup
from codeloom.llm.html_extract import op10_html_extraction
from codeloom.llm.line_dedup import OP7_SQL, op7_line_dedup
from codeloom.llm.neighbours import op9_neighbours
from codeloom.llm.packing import op4_packing
from codeloom.llm.pieces import op2_sentencepiece
from codeloom.llm.quality import op6_quality
from codeloom.llm.secrets import op3_secrets
from codeloom.llm.simhash import op8_simhash
from codeloom.llm.token_output import op1_token_output

QUERIES = {
    "op1_token_output": op1_token_output,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_secrets": op3_secrets,
    "op4_packing": op4_packing,
    "op5_embedding_dedup": op5_embedding_dedup,
    "op6_quality": op6_quality,
    "op7_line_dedup": op7_line_dedup,
    "op8_simhash": op8_simhash,
    "op9_neighbours": op9_neighbours,
    "op10_html_extraction": op10_html_extraction,
}
ORACLE_SQL = {
    "op7_line_dedup": OP7_SQL,
}
