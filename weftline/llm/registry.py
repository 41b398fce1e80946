"""Queries of the training-data operators, and DuckDB SQL where SQL can express them."""

from weftline.llm.decontaminate import op4_decontaminate
from weftline.llm.licenses import LICENSE_BASE_SQL, license_base, op10_licenses
from weftline.llm.line_dedup import OP1_SQL, op1_line_dedup
from weftline.llm.ngram_join import OP7_SQL, op7_ngram_join
from weftline.llm.packing import op8_packing
from weftline.llm.pii import PII_BASE_SQL, op6_pii, pii_base
from weftline.llm.quality_model import op3_quality_model
from weftline.llm.quality_rules import QUALITY_BASE_SQL, op9_quality_rules, quality_base
from weftline.llm.suffix_dedup import op2_suffix_dedup
from weftline.llm.tokens import op5_token_counts

QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_suffix_dedup, op3_quality_model, op4_decontaminate, op5_token_counts, op6_pii, op7_ngram_join, op8_packing, op9_quality_rules, op10_licenses)}
#: The parts of three operators that SQL can express, as queries of their own.
QUERIES |= {f.__name__: f for f in (pii_base, quality_base, license_base)}
ORACLES = {"op1_line_dedup": OP1_SQL, "op7_ngram_join": OP7_SQL, "pii_base": PII_BASE_SQL, "quality_base": QUALITY_BASE_SQL, "license_base": LICENSE_BASE_SQL}
