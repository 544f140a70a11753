"""The queries of this subpackage, and SQL for those that it can express."""

from __future__ import annotations

from paperloom.llm.compact_windows import op7_compact_windows
from paperloom.llm.decontaminate import OP9_SQL, op9_benchmark_decontamination
from paperloom.llm.filter_audit import OP13_SQL, op13_filter_interaction
from paperloom.llm.fingerprint import EDITED_SQL, edited_texts, op4_document_fingerprints
from paperloom.llm.html_extract import op1_html_extraction
from paperloom.llm.jaccard import LINKS_SQL, OP3_SQL, jaccard_links, op3_jaccard_join
from paperloom.llm.language_id import op5_language_id
from paperloom.llm.lm_score import BASE_SQL, base_scores, op6_lm_scoring
from paperloom.llm.mixing import TARGETS_SQL, mixing_targets, op2_mixing_sources
from paperloom.llm.periodic_runs import OP11_SQL, op11_periodic_runs
from paperloom.llm.quality import op10_quality_classifier
from paperloom.llm.simhash import op12_simhash_near_dedup
from paperloom.llm.suffix_dedup import OP8_SQL, op8_suffix_array_dedup

QUERIES = {f.__name__: f for f in (op1_html_extraction, op2_mixing_sources, op3_jaccard_join, op4_document_fingerprints, op5_language_id, op6_lm_scoring, op7_compact_windows, op8_suffix_array_dedup, op9_benchmark_decontamination, op10_quality_classifier, op11_periodic_runs, op12_simhash_near_dedup, op13_filter_interaction, mixing_targets, edited_texts, base_scores, jaccard_links)}
ORACLES = {"mixing_targets": TARGETS_SQL, "edited_texts": EDITED_SQL, "base_scores": BASE_SQL, "op3_jaccard_join": OP3_SQL, "jaccard_links": LINKS_SQL, "op8_suffix_array_dedup": OP8_SQL, "op9_benchmark_decontamination": OP9_SQL, "op11_periodic_runs": OP11_SQL, "op13_filter_interaction": OP13_SQL}
