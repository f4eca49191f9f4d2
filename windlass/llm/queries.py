"""The queries of the training-data operators and their SQL, for __spark_entry__.py."""

from .decontaminate import OP6_SQL, op6_decontaminate
from .embeddings import op1_embeddings
from .hpylm import op2_hpylm
from .html import op7_html
from .jaccard import op8_jaccard
from .lexical import OP13_SQL, op13_lexical
from .pii import op5_pii
from .quality import op3_quality
from .spm import op4_sentencepiece
from .resample import OP12_SQL, op12_resample
from .suffix import op10_suffix
from .toxicity import op11_toxicity
from .warc import OP9_SQL, op9_warc

QUERIES = {"op1_embeddings": op1_embeddings, "op2_hpylm": op2_hpylm, "op7_html": op7_html, "op3_quality": op3_quality, "op4_sentencepiece": op4_sentencepiece, "op5_pii": op5_pii, "op6_decontaminate": op6_decontaminate, "op8_jaccard": op8_jaccard, "op9_warc": op9_warc, "op10_suffix": op10_suffix, "op11_toxicity": op11_toxicity, "op12_resample": op12_resample, "op13_lexical": op13_lexical}
ORACLE = {"op6_decontaminate": OP6_SQL, "op9_warc": OP9_SQL, "op12_resample": OP12_SQL, "op13_lexical": OP13_SQL}
