"""The queries of this package and the SQL that checks them, where SQL can express them."""

from emberframe.llm.ann import op2_ann
from emberframe.llm.byte_bpe import op7_byte_bpe
from emberframe.llm.collocations import op13_collocations
from emberframe.llm.exact_topk import op9_exact_topk
from emberframe.llm.jaccard_join import op8_ngram_jaccard
from emberframe.llm.language_id import op11_language_id
from emberframe.llm.line_dedup import op10_line_dedup
from emberframe.llm.oracle import ORACLE
from emberframe.llm.packing import op6_packing
from emberframe.llm.periodic_runs import op12_periodic_runs
from emberframe.llm.pii import op5_pii
from emberframe.llm.secrets import op4_secret_scan
from emberframe.llm.suffix_dedup import op1_suffix_dedup
from emberframe.llm.toxicity import op3_toxicity

QUERIES = {f.__name__: f for f in (op1_suffix_dedup, op2_ann, op3_toxicity, op4_secret_scan, op5_pii, op6_packing, op7_byte_bpe, op8_ngram_jaccard, op9_exact_topk, op10_line_dedup, op11_language_id, op12_periodic_runs, op13_collocations)}
