"""Queries of the training-data operators and their SQL, for the entry module."""

from __future__ import annotations

from . import doubling, lines, phrases, pivots, warc
from .alignment import op11_alignment
from .bpe import op10_bpe
from .doubling import op13_doubling
from .iblt import op9_fingerprints
from .langid import op5_langid
from .lines import op8_line_dedup
from .neardup import op3_minhash
from .packing import op7_packing
from .passages import op6_suffix_dedup
from .phrases import op12_phrases
from .pivots import op4_pivot_topk
from .toxicity import op2_toxicity
from .warc import op1_warc

QUERIES = {
    "op1_warc": op1_warc,
    "op2_toxicity": op2_toxicity,
    "op3_minhash": op3_minhash,
    "op4_pivot_topk": op4_pivot_topk,
    "op5_langid": op5_langid,
    "op6_suffix_dedup": op6_suffix_dedup,
    "op7_packing": op7_packing,
    "op8_line_dedup": op8_line_dedup,
    "op9_fingerprints": op9_fingerprints,
    "op10_bpe": op10_bpe,
    "op11_alignment": op11_alignment,
    "op12_phrases": op12_phrases,
    "op13_doubling": op13_doubling,
}

ORACLES: dict[str, str] = {
    "op1_warc": warc.ORACLE,
    "op4_pivot_topk": pivots.ORACLE,
    "op8_line_dedup": lines.ORACLE,
    "op12_phrases": phrases.ORACLE,
    "op13_doubling": doubling.ORACLE,
}
