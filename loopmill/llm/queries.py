"""The registered queries of this subpackage and, where SQL can express them, their DuckDB equivalents."""

from __future__ import annotations

from .ann import op6_ann
from .bpe import op4_bpe
from .chat import op8_chat
from .infill import op12_infill
from .langid import op2_language
from .minhash import op13_minhash
from .mixing import op9_mixing
from .pii import op5_pii
from .quality import op1_quality
from .repeats import op7_repeats
from .simhash import op3_simhash
from .sql import CHAT, INFILL, MINHASH, MIXING, QUALITY, VARIANTS
from .toxicity import op10_toxicity
from .variants import op11_variants

QUERIES = {f.__name__: f for f in (op1_quality, op2_language, op3_simhash, op4_bpe, op5_pii, op6_ann, op7_repeats, op8_chat, op9_mixing, op10_toxicity, op11_variants, op12_infill, op13_minhash)}

ORACLE = {"op1_quality": QUALITY, "op8_chat": CHAT, "op9_mixing": MIXING, "op11_variants": VARIANTS, "op12_infill": INFILL, "op13_minhash": MINHASH}
