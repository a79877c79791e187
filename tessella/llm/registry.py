"""The subpackage's queries, and DuckDB SQL where SQL can express one."""

from __future__ import annotations

from . import decontaminate, infill, mixing, secrets, setjoin, sharding, substrings
from .bpe import op1_forced_boundary_bpe
from .decontaminate import op11_suffix_automaton
from .infill import op12_chunked_infill
from .langid import op6_language_profiles
from .media import op2_ogg_media
from .mixing import op9_mix_sources
from .quality import op5_log_ratio_quality
from .secrets import op3_secret_scan
from .setjoin import op10_chosen_path_join
from .sharding import op7_virtual_slots
from .substrings import op8_interval_expansion
from .toxicity import op4_counterfactual_toxicity

QUERIES = {f.__name__: f for f in (op1_forced_boundary_bpe, op2_ogg_media, op3_secret_scan, op4_counterfactual_toxicity, op5_log_ratio_quality, op6_language_profiles, op7_virtual_slots, op8_interval_expansion, op9_mix_sources, op10_chosen_path_join, op11_suffix_automaton, op12_chunked_infill)}
ORACLES = {"op3_secret_scan": secrets.ORACLE, "op7_virtual_slots": sharding.ORACLE, "op8_interval_expansion": substrings.ORACLE, "op9_mix_sources": mixing.ORACLE, "op10_chosen_path_join": setjoin.ORACLE, "op11_suffix_automaton": decontaminate.ORACLE, "op12_chunked_infill": infill.ORACLE}
