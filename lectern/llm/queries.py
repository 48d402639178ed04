"""The queries of this subpackage, by name, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from lectern.llm import (
    op1_simhash,
    op2_token_files,
    op3_decontaminate,
    op4_packing,
    op5_pii,
    op6_media,
    op7_language,
    op8_toxicity,
    op9_token_counts,
    op10_quality,
    op11_best_fit,
    op12_manifest,
    op13_runs,
)

QUERIES = {
    "op1_simhash": op1_simhash.query,
    "op2_token_files": op2_token_files.query,
    "op3_decontaminate": op3_decontaminate.query,
    "op4_packing": op4_packing.query,
    "op5_pii": op5_pii.query,
    "op6_media": op6_media.query,
    "op7_language": op7_language.query,
    "op8_toxicity": op8_toxicity.query,
    "op9_token_counts": op9_token_counts.query,
    "op10_quality": op10_quality.query,
    "op11_best_fit": op11_best_fit.query,
    "op12_manifest": op12_manifest.query,
    "op13_runs": op13_runs.query,
    "pipeline": corpus_pipeline.run,
}

#: Tokenizers, fitted models, alignments and searches have no SQL form here;
#: tests/llm holds each query to a plain version of itself.
ORACLE_SQL: dict[str, str] = {"op12_manifest": op12_manifest.SQL}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
