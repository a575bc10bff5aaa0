"""The registered queries of this folder and, where SQL can say it, their oracles."""

from kgloom.llm.collocations import op12_phrase_collocations
from kgloom.llm.decontaminate import op5_benchmark_decontamination
from kgloom.llm.hard_negatives import op13_hard_negatives
from kgloom.llm.language_id import op10_language_id
from kgloom.llm.licenses import op9_license_scans
from kgloom.llm.line_dedup import op4_line_dedup
from kgloom.llm.lm_scoring import op3_lm_scoring
from kgloom.llm.oracles import ORACLE_SQL  # noqa: F401
from kgloom.llm.packing import op7_best_fit_packing
from kgloom.llm.quality_rules import op1_quality_rules
from kgloom.llm.secrets import op2_secret_scans
from kgloom.llm.simhash import op6_simhash_near_dedup
from kgloom.llm.suffix_arrays import op11_suffix_array_dedup
from kgloom.llm.toxicity import op8_toxicity

QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_secret_scans": op2_secret_scans,
    "op3_lm_scoring": op3_lm_scoring,
    "op4_line_dedup": op4_line_dedup,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_simhash_near_dedup": op6_simhash_near_dedup,
    "op8_toxicity": op8_toxicity,
    "op9_license_scans": op9_license_scans,
    "op10_language_id": op10_language_id,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op11_suffix_array_dedup": op11_suffix_array_dedup,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_hard_negatives": op13_hard_negatives,
}

