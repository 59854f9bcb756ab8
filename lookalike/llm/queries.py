"""Queries of this subpackage and their SQL, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from lookalike.llm.chat import SQL as OP7_SQL
from lookalike.llm.chat import op7_chat_format
from lookalike.llm.collocations import SQL as OP13_SQL
from lookalike.llm.collocations import op13_collocations
from lookalike.llm.hamming_search import SQL as OP2_SQL
from lookalike.llm.hamming_search import op2_hamming_topk
from lookalike.llm.html_extract import op1_html_text
from lookalike.llm.inverted import SQL as OP4_SQL
from lookalike.llm.inverted import op4_decontaminate
from lookalike.llm.packing import op5_packing
from lookalike.llm.phrase_automata import SQL as OP3_SQL
from lookalike.llm.phrase_automata import op3_phrase_dedup
from lookalike.llm.quality import op9_quality
from lookalike.llm.ranked_search import SQL as OP12_SQL
from lookalike.llm.ranked_search import op12_ranked_search
from lookalike.llm.simhash import op6_simhash
from lookalike.llm.suffix_dedup import SQL as OP10_SQL
from lookalike.llm.suffix_dedup import op10_suffix_dedup
from lookalike.llm.toxicity import op8_toxicity
from lookalike.llm.url_filters import SQL as OP11_SQL
from lookalike.llm.url_filters import op11_url_filters

QUERIES = {
    "op1_html_text": op1_html_text,
    "op2_hamming_topk": op2_hamming_topk,
    "op3_phrase_dedup": op3_phrase_dedup,
    "op4_decontaminate": op4_decontaminate,
    "op5_packing": op5_packing,
    "op6_simhash": op6_simhash,
    "op7_chat_format": op7_chat_format,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_url_filters": op11_url_filters,
    "op12_ranked_search": op12_ranked_search,
    "op13_collocations": op13_collocations,
}

ORACLE = {"op2_hamming_topk": OP2_SQL, "op3_phrase_dedup": OP3_SQL, "op4_decontaminate": OP4_SQL, "op7_chat_format": OP7_SQL, "op10_suffix_dedup": OP10_SQL, "op11_url_filters": OP11_SQL, "op12_ranked_search": OP12_SQL, "op13_collocations": OP13_SQL}
