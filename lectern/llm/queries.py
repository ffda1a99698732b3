"""Queries of this subpackage and the SQL that their rows are held against."""

from __future__ import annotations

from lectern.llm.bpe import op1_bpe
from lectern.llm.collocations import OP11_SQL, op11_collocations
from lectern.llm.chat import OP4_SQL, op4_chat
from lectern.llm.dartminhash import op10_near_dedup
from lectern.llm.divergence import OP13_SQL, op13_divergence
from lectern.llm.mixing import op9_mixing
from lectern.llm.multiset import op5_fingerprints
from lectern.llm.pitmanyor import op2_lm
from lectern.llm.quality import OP8_SQL, op8_quality
from lectern.llm.secrets import op6_secrets
from lectern.llm.tokencount import op12_token_counts
from lectern.llm.toxicity import op7_toxicity
from lectern.llm.warc import OP3_SQL, op3_warc

QUERIES = {
    f.__name__: f
    for f in (op1_bpe, op2_lm, op3_warc, op4_chat, op5_fingerprints, op6_secrets, op7_toxicity, op8_quality, op9_mixing, op10_near_dedup, op11_collocations, op12_token_counts, op13_divergence)
}
SQL = {"op3_warc": OP3_SQL, "op4_chat": OP4_SQL, "op8_quality": OP8_SQL, "op11_collocations": OP11_SQL, "op13_divergence": OP13_SQL}
