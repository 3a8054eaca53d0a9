"""The queries of the corpus operators and, where SQL can express them, their SQL."""

from __future__ import annotations

from .decontaminate import OP6_SQL, op6_decontaminate
from .divergence import OP11_SQL, op11_source_divergence
from .kneser_ney import op3_kneser_ney
from .langid import op2_langid
from .minhash import OP1_SQL, op1_near_duplicates
from .mixing import OP4_SQL, op4_mixing
from .quality import op9_quality
from .sharding import OP8_SQL, op8_sharding
from .substrings import OP12_SQL, op12_substring_dedup
from .token_count import op10_token_count
from .token_output import op5_token_output
from .vector_codes import OP13_SQL, op13_vector_codes
from .warc import OP7_SQL, op7_warc

QUERIES = {f.__name__: f for f in (op1_near_duplicates, op2_langid, op3_kneser_ney, op4_mixing, op5_token_output, op6_decontaminate, op7_warc, op8_sharding, op9_quality, op10_token_count, op11_source_divergence, op12_substring_dedup, op13_vector_codes)}
SQL = {"op1_near_duplicates": OP1_SQL, "op4_mixing": OP4_SQL, "op6_decontaminate": OP6_SQL, "op7_warc": OP7_SQL, "op8_sharding": OP8_SQL, "op11_source_divergence": OP11_SQL, "op12_substring_dedup": OP12_SQL, "op13_vector_codes": OP13_SQL}
