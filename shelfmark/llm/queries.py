"""Queries of this folder and their DuckDB SQL, by name."""

from __future__ import annotations

from shelfmark.llm.align import op11_align
from shelfmark.llm.bpe_codec import op5_bpe_codec
from shelfmark.llm.chat import OP13_SQL, op13_chat
from shelfmark.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from shelfmark.llm.huffman import op3_huffman_ids
from shelfmark.llm.line_dedup import OP10_SQL, op10_line_dedup
from shelfmark.llm.lz_fingerprint import op1_lz_fingerprint
from shelfmark.llm.packing import op9_best_fit
from shelfmark.llm.pii import op6_pii
from shelfmark.llm.quality import op8_quality
from shelfmark.llm.simhash import op7_simhash
from shelfmark.llm.toxicity import op2_toxicity
from shelfmark.llm.warc import OP4_SQL, op4_warc

QUERIES = {f.__name__: f for f in (op1_lz_fingerprint, op2_toxicity, op3_huffman_ids, op4_warc, op5_bpe_codec, op6_pii, op7_simhash, op8_quality, op9_best_fit, op10_line_dedup, op11_align, op12_hard_negatives, op13_chat)}
ORACLES = {"op4_warc": OP4_SQL, "op10_line_dedup": OP10_SQL, "op12_hard_negatives": OP12_SQL, "op13_chat": OP13_SQL}
