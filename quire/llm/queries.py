"""Queries of the corpus operators over their whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from quire.llm.exact_dedup import OP7_SQL, op7_exact_dedup
from quire.llm.html_extract import op5_html_extract
from quire.llm.language_id import op13_language_id
from quire.llm.lexical_search import OP11_SQL, op11_lexical_search
from quire.llm.licenses import op10_license_scan
from quire.llm.mixing import op9_mixing
from quire.llm.pieces import op6_sentencepiece
from quire.llm.quality_model import op3_quality_model
from quire.llm.quality_rules import op2_quality_rules
from quire.llm.rolling_median import OP12_SQL, op12_rolling_median
from quire.llm.sharding import op1_sharding
from quire.llm.simhash import op4_simhash
from quire.llm.warc import OP8_SQL, op8_warc

QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_quality_rules": op2_quality_rules,
    "op3_quality_model": op3_quality_model,
    "op4_simhash": op4_simhash,
    "op5_html_extract": op5_html_extract,
    "op6_sentencepiece": op6_sentencepiece,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_warc": op8_warc,
    "op9_mixing": op9_mixing,
    "op10_license_scan": op10_license_scan,
    "op11_lexical_search": op11_lexical_search,
    "op12_rolling_median": op12_rolling_median,
    "op13_language_id": op13_language_id,
}

ORACLES = {
    "op7_exact_dedup": OP7_SQL,
    "op8_warc": OP8_SQL,
    "op11_lexical_search": OP11_SQL,
    "op12_rolling_median": OP12_SQL,
}
