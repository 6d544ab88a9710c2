"""Queries of this subpackage by name, and their SQL where SQL can say them."""

from __future__ import annotations

from resonarium.llm.audit import OP13_SQL, op13_filters
from resonarium.llm.decontaminate import OP9_SQL, op9_decontaminate
from resonarium.llm.embeddings import OP1_SQL, op1_embeddings
from resonarium.llm.langid import op2_langid
from resonarium.llm.leaks import OP12_SQL, op12_secrets
from resonarium.llm.lines import op5_lines
from resonarium.llm.mixing import OP4_SQL, op4_mixing
from resonarium.llm.pii import OP8_SQL, op8_pii
from resonarium.llm.sharding import op7_sharding
from resonarium.llm.simhash import op6_simhash
from resonarium.llm.substring import OP3_SQL, op3_substring
from resonarium.llm.tries import OP11_SQL, op11_prefixes
from resonarium.llm.warc import OP10_SQL, op10_warc

QUERIES = {
    "op1_embeddings": op1_embeddings,
    "op2_langid": op2_langid,
    "op3_substring": op3_substring,
    "op4_mixing": op4_mixing,
    "op5_lines": op5_lines,
    "op6_simhash": op6_simhash,
    "op7_sharding": op7_sharding,
    "op8_pii": op8_pii,
    "op9_decontaminate": op9_decontaminate,
    "op10_warc": op10_warc,
    "op11_prefixes": op11_prefixes,
    "op12_secrets": op12_secrets,
    "op13_filters": op13_filters,
}
SQL = {"op1_embeddings": OP1_SQL, "op3_substring": OP3_SQL, "op4_mixing": OP4_SQL, "op8_pii": OP8_SQL, "op9_decontaminate": OP9_SQL, "op10_warc": OP10_SQL, "op11_prefixes": OP11_SQL, "op12_secrets": OP12_SQL, "op13_filters": OP13_SQL}
