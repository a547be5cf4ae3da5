"""Queries of this package and their SQL, by name."""

from __future__ import annotations

from .ann import op3_forest_neighbours
from .bpe import op10_bpe_codec
from .decontam import OP12_SQL, op12_decontamination
from .divergence import OP11_SQL, op11_source_divergence
from .hardneg import OP13_SQL, op13_hard_negatives
from .langid import op4_language_id
from .lm import op5_bloom_lm
from .media import op7_media_columns
from .neardup import OP6_SQL, op6_minhash_dedup
from .packing import op8_window_packing
from .quality import op2_quality_cotraining
from .quotes import OP1_SQL, op1_quotation_linking
from .toxicity import op9_toxic_spans


def queries() -> dict:
    return {
        "op1_quotation_linking": op1_quotation_linking,
        "op2_quality_cotraining": op2_quality_cotraining,
        "op3_forest_neighbours": op3_forest_neighbours,
        "op4_language_id": op4_language_id,
        "op5_bloom_lm": op5_bloom_lm,
        "op6_minhash_dedup": op6_minhash_dedup,
        "op7_media_columns": op7_media_columns,
        "op8_window_packing": op8_window_packing,
        "op9_toxic_spans": op9_toxic_spans,
        "op10_bpe_codec": op10_bpe_codec,
        "op11_source_divergence": op11_source_divergence,
        "op12_decontamination": op12_decontamination,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quotation_linking": OP1_SQL, "op6_minhash_dedup": OP6_SQL, "op11_source_divergence": OP11_SQL, "op12_decontamination": OP12_SQL, "op13_hard_negatives": OP13_SQL}
