"""The queries of this subpackage, by name."""

from __future__ import annotations

from corpuscle.llm.bpe import op1_byte_bpe
from corpuscle.llm.embeddings import op6_embedding_dedup
from corpuscle.llm.licenses import op2_license_scan
from corpuscle.llm.lines import op4_line_dedup
from corpuscle.llm.lm import op10_lm_scores
from corpuscle.llm.mixing import op3_mixing
from corpuscle.llm.quality import op8_quality_rules
from corpuscle.llm.simhash import op5_simhash
from corpuscle.llm.urls import op7_url_filter
from corpuscle.llm.warc import OP9_SQL, op9_warc

QUERIES = {"op1_byte_bpe": op1_byte_bpe, "op2_license_scan": op2_license_scan, "op3_mixing": op3_mixing, "op4_line_dedup": op4_line_dedup, "op5_simhash": op5_simhash, "op6_embedding_dedup": op6_embedding_dedup, "op7_url_filter": op7_url_filter, "op8_quality_rules": op8_quality_rules, "op9_warc": op9_warc, "op10_lm_scores": op10_lm_scores}
ORACLES = {"op9_warc": OP9_SQL}
