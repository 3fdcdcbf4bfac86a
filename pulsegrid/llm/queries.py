"""The training-data queries and their SQL, where SQL can express them."""

from .audit import OP13_SQL, op13_filter_audit
from .bpe import op7_bpe
from .codes import OP11_SQL, op11_vector_codes
from .langid import op3_language_id
from .licenses import op6_licenses
from .ngramjoin import OP12_SQL, op12_ngram_join
from .packing import op8_packing
from .quality import OP9_SQL, op9_quality
from .simhash import op4_simhash
from .substrings import OP10_SQL, op10_substrings
from .topk import OP2_SQL, op2_topk
from .toxicity import op5_toxicity
from .warc import OP1_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_topk": op2_topk,
    "op3_language_id": op3_language_id,
    "op4_simhash": op4_simhash,
    "op5_toxicity": op5_toxicity,
    "op6_licenses": op6_licenses,
    "op7_bpe": op7_bpe,
    "op8_packing": op8_packing,
    "op9_quality": op9_quality,
    "op10_substrings": op10_substrings,
    "op11_vector_codes": op11_vector_codes,
    "op12_ngram_join": op12_ngram_join,
    "op13_filter_audit": op13_filter_audit,
}
SQL = {"op1_warc": OP1_SQL, "op2_topk": OP2_SQL, "op9_quality": OP9_SQL, "op10_substrings": OP10_SQL, "op11_vector_codes": OP11_SQL, "op12_ngram_join": OP12_SQL, "op13_filter_audit": OP13_SQL}
