"""Queries of this subpackage and their SQL, for ``__spark_entry__.py``."""

from __future__ import annotations

from .bloom_lm import op3_bloom_lm
from .bpe_codec import op5_bpe_codec
from .chat_events import op8_chat_events
from .conversation_repair import op13_lattice_repair
from .decontamination import op12_window_leaks
from .e8_lattice import op2_e8_lattice
from .fingerprints import op7_fingerprints
from .histogram_packing import op4_histogram_packing
from .quality_qda import op1_quality_qda
from .repeat_index import op10_repeat_index
from .simhash_trie import op9_simhash_trie
from .tiered_search import op11_tiered_search
from .token_output import op6_token_output

QUERIES = {
    "op1_quality_qda": op1_quality_qda,
    "op2_e8_lattice": op2_e8_lattice,
    "op3_bloom_lm": op3_bloom_lm,
    "op4_histogram_packing": op4_histogram_packing,
    "op5_bpe_codec": op5_bpe_codec,
    "op6_token_output": op6_token_output,
    "op7_fingerprints": op7_fingerprints,
    "op8_chat_events": op8_chat_events,
    "op9_simhash_trie": op9_simhash_trie,
    "op10_repeat_index": op10_repeat_index,
    "op11_tiered_search": op11_tiered_search,
    "op12_window_leaks": op12_window_leaks,
    "op13_lattice_repair": op13_lattice_repair,
}
ORACLE_SQL: dict[str, str] = {}
