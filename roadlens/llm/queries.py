"""Queries of the training-data operators, as registered with the driver."""

from __future__ import annotations

from .bpe import op1_bpe_chunk_reuse
from .chat import OP11_SQL, op11_chat_incremental
from .clustering import OP13_SQL, op13_centroid_dictionaries
from .fixity import OP6_SQL, op6_warc_merkle_audit
from .line_dedup import op2_line_dedup_minhash
from .mixing import op4_mix_entropy_balance
from .ngram_join import op9_ngram_jaccard_join
from .quality import op5_quality_decision_list
from .sharding import op8_shard_hash_tree
from .token_output import op3_token_shards_feistel
from .topk import OP7_SQL, op7_topk_norm_buckets
from .toxicity import op10_toxicity_ftrl
from .whitening import op12_whiten_qdwh

QUERIES = {
    "op1_bpe_chunk_reuse": op1_bpe_chunk_reuse,
    "op2_line_dedup_minhash": op2_line_dedup_minhash,
    "op3_token_shards_feistel": op3_token_shards_feistel,
    "op4_mix_entropy_balance": op4_mix_entropy_balance,
    "op5_quality_decision_list": op5_quality_decision_list,
    "op6_warc_merkle_audit": op6_warc_merkle_audit,
    "op7_topk_norm_buckets": op7_topk_norm_buckets,
    "op8_shard_hash_tree": op8_shard_hash_tree,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_toxicity_ftrl": op10_toxicity_ftrl,
    "op11_chat_incremental": op11_chat_incremental,
    "op12_whiten_qdwh": op12_whiten_qdwh,
    "op13_centroid_dictionaries": op13_centroid_dictionaries,
}

ORACLE_SQL: dict[str, str] = {
    "op6_warc_merkle_audit": OP6_SQL,
    "op7_topk_norm_buckets": OP7_SQL,
    "op11_chat_incremental": OP11_SQL,
    "op13_centroid_dictionaries": OP13_SQL,
}
