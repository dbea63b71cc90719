"""The queries of this subpackage and, where SQL can say it, their oracle."""

from __future__ import annotations

import corpus_pipeline
from pagelode.llm.bpe import op5_byte_bpe
from pagelode.llm.bwt import OP7_SQL, op7_suffix_dedup
from pagelode.llm.fingerprints import op2_fingerprints
from pagelode.llm.langid import op9_language_id
from pagelode.llm.mixing import op8_mixing
from pagelode.llm.probminhash import op1_probminhash
from pagelode.llm.recompression import OP10_SQL, op10_recompression
from pagelode.llm.sharding import op3_sharding
from pagelode.llm.topk import OP6_SQL, op6_topk
from pagelode.llm.toxicity import op4_toxicity


OPERATORS = (
    op1_probminhash,
    op2_fingerprints,
    op3_sharding,
    op4_toxicity,
    op5_byte_bpe,
    op6_topk,
    op7_suffix_dedup,
    op8_mixing,
    op9_language_id,
    op10_recompression,
)


def queries() -> dict:
    return {**{f.__name__: f for f in OPERATORS}, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op6_topk": OP6_SQL, "op7_suffix_dedup": OP7_SQL, "op10_recompression": OP10_SQL}
