"""The corpus pipeline: quality rules, near-duplicate join, decontamination, secret redaction, mixing.

The stages lie in the llm subpackage; this file names them for callers that look for it here.
"""

from __future__ import annotations

from skuloom.llm.pipeline import COLUMNS, STAGES, decontaminate_stage, dedupe_stage, mixing_stage, quality_stage, run, secret_stage

__all__ = [
    "COLUMNS", "ORACLE_SQL", "STAGES", "decontaminate_stage", "dedupe_stage", "mixing_stage", "quality_stage", "run", "secret_stage",
]

# Connected components over all links and the mix's permutations are tested against brute force instead.
ORACLE_SQL = None
