"""Queries of the corpus operators and their DuckDB SQL, by name."""

from . import chat, decontamination, filter_audit, near_dedup, trie
from .chat import op6_chat
from .decontamination import op3_decontamination
from .filter_audit import op12_filter_audit
from .html_template import op8_html_extraction
from .media import op10_media
from .near_dedup import op5_near_dedup
from .pii import op9_pii
from .quality import op13_quality
from .sentencepiece import op2_sentencepiece
from .sharding import op7_sharding
from .token_files import op4_token_files
from .toxicity import op1_toxicity
from .trie import op11_prefix_trie

QUERIES = {f.__name__: f for f in (op1_toxicity, op2_sentencepiece, op3_decontamination, op4_token_files, op5_near_dedup, op6_chat, op7_sharding, op8_html_extraction, op9_pii, op10_media, op11_prefix_trie, op12_filter_audit, op13_quality)}
ORACLE_SQL: dict[str, str] = {"op3_decontamination": decontamination.ORACLE, "op5_near_dedup": near_dedup.ORACLE, "op6_chat": chat.ORACLE, "op11_prefix_trie": trie.ORACLE, "op12_filter_audit": filter_audit.ORACLE}
