"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .chat_format import op2_chat_format
from .decontamination import op1_decontamination
from .html_extraction import op8_html_extraction
from .language_id import op3_language_id
from .lexical_search import op12_lexical_search
from .mixing import op6_mixing
from .near_dup import op4_near_dup
from .oracle import SQL
from .periodic_runs import op11_periodic_runs
from .quality_classifier import op9_quality_classifier
from .quality_rules import op10_quality_rules
from .secret_scan import op7_secret_scan
from .sharding import op5_sharding
from .suffix_dedup import op13_suffix_dedup

QUERIES = {f.__name__: f for f in (
    op1_decontamination, op2_chat_format, op3_language_id, op4_near_dup, op5_sharding, op6_mixing,
    op7_secret_scan, op8_html_extraction, op9_quality_classifier, op10_quality_rules, op11_periodic_runs, op12_lexical_search,
    op13_suffix_dedup)}

__all__ = ["QUERIES", "SQL"]
