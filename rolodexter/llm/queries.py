"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers

from .alignment import op13_alignment
from .bpe import op2_bpe
from .common import documents
from .exact_dedup import OP1_SQL, op1_exact_dedup
from .language import op7_language
from .lm_scoring import op9_lm_scoring
from .media import op8_media
from .mixing import op4_mixing
from .near_dedup import OP6_SQL, op6_near_dedup
from .secrets import op5_secrets
from .sharding import op10_sharding
from .simhash import op11_simhash
from .suffix_dedup import OP3_SQL, op3_suffix_dedup
from .whitening import embeddings, op12_whitening

#: The public vocabulary file; at the same place on driver and executors.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")

QUERIES = {
    "op1_exact_dedup": lambda s, d: op1_exact_dedup(documents(s, d)),
    "op2_bpe": lambda s, d: op2_bpe(documents(s, d), TOKENIZER),
    "op3_suffix_dedup": lambda s, d: op3_suffix_dedup(documents(s, d)),
    "op4_source_mixing": lambda s, d: op4_mixing(documents(s, d)),
    "op5_secret_scan": lambda s, d: op5_secrets(documents(s, d)),
    "op6_near_dedup": lambda s, d: op6_near_dedup(documents(s, d)),
    "op7_language_id": lambda s, d: op7_language(documents(s, d)),
    "op8_media_columns": lambda s, d: op8_media(documents(s, d)),
    "op9_lm_scoring": lambda s, d: op9_lm_scoring(documents(s, d)),
    "op10_sharding": lambda s, d: op10_sharding(documents(s, d)),
    "op11_simhash_near_dedup": lambda s, d: op11_simhash(documents(s, d)),
    "op12_embedding_whitening": lambda s, d: op12_whitening(embeddings(s, d)),
    "op13_tokenizer_alignment": lambda s, d: op13_alignment(documents(s, d), BYTE_BPE, PIECES),
}

ORACLE_SQL: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op3_suffix_dedup": OP3_SQL, "op6_near_dedup": OP6_SQL}
