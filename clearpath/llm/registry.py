"""Queries of this subpackage and, where SQL can express them, the same in DuckDB SQL."""

from __future__ import annotations

from . import chat, mixing, repair, warc
from .chat import op2_chat_formatting
from .language import op7_language_id
from .mixing import op1_mixing
from .neardup import op9_near_duplicates
from .neighbours import op8_nearest_neighbours
from .packing import op10_packing
from .quality import op6_quality_rules
from .repair import op13_conversation_repair
from .tokenfile import op3_token_file
from .toxicity import op4_toxicity
from .vectordup import op12_embedding_near_duplicates
from .warc import op5_warc
from .whitening import op11_embedding_whitening

QUERIES = {
    "op1_mixing": op1_mixing,
    "op2_chat_formatting": op2_chat_formatting,
    "op3_token_file": op3_token_file,
    "op4_toxicity": op4_toxicity,
    "op5_warc": op5_warc,
    "op6_quality_rules": op6_quality_rules,
    "op7_language_id": op7_language_id,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_near_duplicates": op9_near_duplicates,
    "op10_packing": op10_packing,
    "op11_embedding_whitening": op11_embedding_whitening,
    "op12_embedding_near_duplicates": op12_embedding_near_duplicates,
    "op13_conversation_repair": op13_conversation_repair,
}
ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.ORACLE,
    "op2_chat_formatting": chat.ORACLE,
    "op5_warc": warc.ORACLE,
    "op13_conversation_repair": repair.ORACLE,
}
