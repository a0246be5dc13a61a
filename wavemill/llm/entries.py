"""The queries of the corpus operators and the SQL that checks them."""

from __future__ import annotations

from .chat import op6_chat_snapshots
from .decontaminate import op10_benchmark_leaks
from .fill_middle import op11_fill_in_middle
from .html_text import op1_html_main_text
from .katz import op9_katz_scoring
from .mixing import op2_pivotal_mixing
from .near_duplicates import op8_near_duplicates
from .oracles import ORACLES as ORACLES
from .periodic_runs import op12_periodic_runs
from .quality_classifier import op7_quality_classifier
from .quality_rules import op5_quality_rules
from .secrets import op3_secret_scan
from .substrings import op4_substring_dedup
from .super_minhash import op13_superminhash_dedup

QUERIES = {
    "op1_html_main_text": op1_html_main_text,
    "op2_pivotal_mixing": op2_pivotal_mixing,
    "op3_secret_scan": op3_secret_scan,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_quality_rules": op5_quality_rules,
    "op6_chat_snapshots": op6_chat_snapshots,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_katz_scoring": op9_katz_scoring,
    "op10_benchmark_leaks": op10_benchmark_leaks,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_superminhash_dedup": op13_superminhash_dedup,
}
