"""The thin ``opN_<name>`` queries: production parameters over whole tables."""

from trawl.llm.bpe import op9_query
from trawl.llm.chat import op6_query
from trawl.llm.lm import op3_query
from trawl.llm.media import op7_query
from trawl.llm.mixing import OP2_SQL, op2_query
from trawl.llm.neardup_vectors import op5_query
from trawl.llm.pii import op4_query
from trawl.llm.sharding import op1_query
from trawl.llm.simjoin import op8_query
from trawl.llm.toxicity import op10_query

QUERIES = {
    "op1_interleave": op1_query,
    "op2_mix_ipf": op2_query,
    "op3_deleted_interpolation": op3_query,
    "op4_pii_crf": op4_query,
    "op5_pca_tiles": op5_query,
    "op6_chat_tree": op6_query,
    "op7_media_columns": op7_query,
    "op8_ngram_jaccard": op8_query,
    "op9_bpe_codec": op9_query,
    "op10_toxicity_grammar": op10_query,
}

#: Hashes that DuckDB lacks (CRC-32, XXH64) and trained models keep the others out of SQL.
ORACLE_SQL: dict[str, str] = {
    "op2_mix_ipf": OP2_SQL,
}
