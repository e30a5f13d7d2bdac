"""The queries of the training-data operators, each over its whole table, and SQL for those that SQL can state."""

from __future__ import annotations

from .byte_bpe import op13_byte_bpe
from .conversation_repair import op12_conversation_repair
from .html_text import op3_html_extraction
from .kd_sharding import op7_kd_sharding
from .mixing import op8_mixing
from .near_dedup import op4_near_dedup
from .packing import op5_best_fit_packing
from .quality_classifier import op9_quality_classifier
from .quality_rules import op1_quality_rules
from .spelling_variants import op11_spelling_variants
from .tiff import op2_tiff_media
from .toxicity import op6_toxicity
from .warc import op10_warc

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_tiff_media, op3_html_extraction, op4_near_dedup, op5_best_fit_packing, op6_toxicity, op7_kd_sharding, op8_mixing, op9_quality_classifier, op10_warc, op11_spelling_variants, op12_conversation_repair, op13_byte_bpe)}
ORACLES: dict[str, str] = {}
