"""The queries of this package by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from mentionlake.llm.align import op13_alignment
from mentionlake.llm.bpe import op8_bpe
from mentionlake.llm.decontaminate import op1_decontaminate
from mentionlake.llm.fingerprint import op7_fingerprints
from mentionlake.llm.licenses import op5_licenses
from mentionlake.llm.near import op3_near_duplicates
from mentionlake.llm.pii import op9_pii
from mentionlake.llm.quality import op10_quality_classifier
from mentionlake.llm.secrets import op4_secrets
from mentionlake.llm.simhash import op12_simhash
from mentionlake.llm.substring import op2_substring_dedup
from mentionlake.llm.toxicity import op6_toxicity
from mentionlake.llm.whitening import op11_whitening

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_secrets": op4_secrets,
    "op5_licenses": op5_licenses,
    "op6_toxicity": op6_toxicity,
    "op7_fingerprints": op7_fingerprints,
    "op8_bpe": op8_bpe,
    "op9_pii": op9_pii,
    "op10_quality_classifier": op10_quality_classifier,
    "op11_whitening": op11_whitening,
    "op12_simhash": op12_simhash,
    "op13_alignment": op13_alignment,
}

ORACLE: dict[str, str] = {}
