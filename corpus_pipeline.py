"""The corpus pipeline: quality, near copies, benchmark decontamination, personal data, packing."""

from __future__ import annotations

from graphloom.llm.stages import STAGES, run

#: The stages are trained or iterative; tests/llm checks run() against brute force.
ORACLE_SQL = None

__all__ = ["ORACLE_SQL", "STAGES", "run"]
