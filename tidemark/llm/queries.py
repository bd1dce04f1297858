"""Queries of this subpackage: name -> function(spark, sf_dir); SQL where SQL can express them."""

from __future__ import annotations

from .decontaminate import op9_decontamination
from .jaccard_join import op6_jaccard_join
from .language_id import op2_language_id
from .lexical_search import op13_lexical_search
from .oracles import ORACLES
from .pieces import op3_pieces
from .pii import op7_pii
from .quality_classifier import op5_quality_classifier
from .quality_rules import op1_quality_rules
from .separator_scan import op4_separator_scan
from .sharding import op8_jump_hash
from .substring_dedup import op10_substring_dedup
from .whitening import op11_whitening
from .word_pairs import op12_word_pairs

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_language_id, op3_pieces, op4_separator_scan, op5_quality_classifier, op6_jaccard_join, op7_pii, op8_jump_hash, op9_decontamination, op10_substring_dedup, op11_whitening, op12_word_pairs, op13_lexical_search)}
__all__ = ["ORACLES", "QUERIES"]
