"""The registered queries of this subpackage and their SQL."""

from textloom.llm.ann import op10_ann
from textloom.llm.byte_bpe import op7_byte_bpe
from textloom.llm.chat_format import OP1_SQL, op1_chat_format
from textloom.llm.fill_in_middle import OP12_SQL, op12_fill_in_middle
from textloom.llm.language_id import op9_language_id
from textloom.llm.lm_scoring import op2_lm_scoring
from textloom.llm.odd_sketch import op13_minhash_dedup
from textloom.llm.packing import op5_packing
from textloom.llm.quality import OP6_SQL, op6_quality_rules
from textloom.llm.simhash_dedup import op3_simhash_dedup
from textloom.llm.spelling import OP11_SQL, op11_spelling_variants
from textloom.llm.token_counts import op8_token_counts
from textloom.llm.warc import OP4_SQL, op4_warc

QUERIES = {f.__name__: f for f in (op1_chat_format, op2_lm_scoring, op3_simhash_dedup, op4_warc, op5_packing, op6_quality_rules, op7_byte_bpe, op8_token_counts, op9_language_id, op10_ann, op11_spelling_variants, op12_fill_in_middle, op13_minhash_dedup)}
ORACLE_SQL = {"op1_chat_format": OP1_SQL, "op4_warc": OP4_SQL, "op6_quality_rules": OP6_SQL, "op11_spelling_variants": OP11_SQL, "op12_fill_in_middle": OP12_SQL}
