"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .decontaminate import op8_decontaminate
from .html import op5_html_text
from .langid import op10_language_id
from .nearcopies import op2_ngram_jaccard
from .pieces import op7_sentencepiece
from .pii import op3_pii
from .sharding import op6_sharding
from .suffixdedup import op1_suffix_dedup
from .urlfilter import op4_url_filter
from .winnowing import op9_winnowing

QUERIES = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_ngram_jaccard, op3_pii, op4_url_filter, op5_html_text, op6_sharding, op7_sentencepiece, op8_decontaminate, op9_winnowing, op10_language_id)
}
ORACLE_SQL: dict[str, str] = {}
