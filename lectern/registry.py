"""Every registered query with its DuckDB SQL."""

from __future__ import annotations

from .plans import contexts, dialogue, drafts, evaluation, files, grounding, lessons, mathchecks, planning, records, relations, retrieval, segmentation, streams, texts, tutoring  # noqa: F401
from .plans.base import ORACLES, QUERIES

FLAGSHIP = "r01_lexical_top4"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
