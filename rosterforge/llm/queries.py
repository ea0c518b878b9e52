"""Registered queries of this package and their SQL twins."""

from __future__ import annotations

from rosterforge.llm.decontaminate import OP5_SQL, op5
from rosterforge.llm.embedding_pairs import OP4_SQL, op4
from rosterforge.llm.filter_audit import OP12_SQL, op12
from rosterforge.llm.html_text import op2
from rosterforge.llm.line_dedup import OP7_SQL, op7
from rosterforge.llm.mixing import OP9_SQL, op9
from rosterforge.llm.ngram_join import OP6_SQL, op6
from rosterforge.llm.periodic_runs import op13
from rosterforge.llm.recompression import OP11_SQL, op11
from rosterforge.llm.sharding import op1
from rosterforge.llm.token_edits import op8
from rosterforge.llm.toxicity import op10
from rosterforge.llm.warc import OP3_SQL, op3

QUERIES = {"op1_shuffle_shards": op1, "op2_page_text": op2, "op3_warc_members": op3, "op4_near_vectors": op4, "op5_decontaminate": op5,
           "op6_ngram_join": op6, "op7_line_dedup": op7, "op8_edited_counts": op8, "op9_mix_sources": op9, "op10_toxicity": op10, "op11_repeated_passages": op11, "op12_filter_audit": op12, "op13_periodic_runs": op13}
ORACLES = {"op3_warc_members": OP3_SQL, "op4_near_vectors": OP4_SQL, "op5_decontaminate": OP5_SQL, "op6_ngram_join": OP6_SQL, "op7_line_dedup": OP7_SQL, "op9_mix_sources": OP9_SQL, "op11_repeated_passages": OP11_SQL, "op12_filter_audit": OP12_SQL}
