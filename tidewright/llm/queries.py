"""The queries of this subpackage, for the registry at the repository top."""

from __future__ import annotations

from tidewright.llm.exact import ORACLE_SQL as EXACT_SQL
from tidewright.llm.exact import op12_exact_dedup
from tidewright.llm.html_text import op10_main_text
from tidewright.llm.language import op7_language
from tidewright.llm.language_model import op4_hidden_markov
from tidewright.llm.media import op9_media
from tidewright.llm.packing import op6_pack
from tidewright.llm.prefix_trie import op11_prefix_trie
from tidewright.llm.quality import op1_robust_outliers
from tidewright.llm.simhash import op3_simhash
from tidewright.llm.spelling import op13_spelling
from tidewright.llm.token_count import op2_token_counts
from tidewright.llm.toxicity import op5_toxicity
from tidewright.llm.transducer import op8_transducer

QUERIES = {"op1_robust_outliers": op1_robust_outliers, "op2_token_counts": op2_token_counts, "op3_simhash": op3_simhash, "op4_hidden_markov": op4_hidden_markov, "op5_toxicity": op5_toxicity, "op6_pack": op6_pack, "op7_language": op7_language, "op8_transducer": op8_transducer, "op9_media": op9_media, "op10_main_text": op10_main_text, "op11_prefix_trie": op11_prefix_trie, "op12_exact_dedup": op12_exact_dedup, "op13_spelling": op13_spelling}
ORACLES = {"op12_exact_dedup": EXACT_SQL}
