"""The subpackage's queries and, where SQL can express them, their DuckDB statements."""

from __future__ import annotations

from terrane.llm.chat import OP9_SQL, op9_quotation_linking
from terrane.llm.decontam import OP3_SQL, op3_benchmark_decontamination
from terrane.llm.hmm import op8_hmm_score
from terrane.llm.lines import op4_line_dedup
from terrane.llm.media import op6_media_sniffing
from terrane.llm.mixing import OP1_SQL, op1_mix_sources
from terrane.llm.pii import op5_pii_surrogates
from terrane.llm.simhash import op10_simhash_near_dedup
from terrane.llm.substring import OP2_SQL, op2_substring_dedup
from terrane.llm.toxicity import op7_toxicity

QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_line_dedup": op4_line_dedup,
    "op5_pii_surrogates": op5_pii_surrogates,
    "op6_media_sniffing": op6_media_sniffing,
    "op7_toxicity": op7_toxicity,
    "op8_hmm_score": op8_hmm_score,
    "op9_quotation_linking": op9_quotation_linking,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
}

ORACLES: dict[str, str] = {"op1_mix_sources": OP1_SQL, "op2_substring_dedup": OP2_SQL, "op3_benchmark_decontamination": OP3_SQL, "op9_quotation_linking": OP9_SQL}
