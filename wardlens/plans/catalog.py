"""Imports every registered query module and exposes the two registries."""

from __future__ import annotations

from . import (q_describe, q_identity, q_metrics, q_quality, q_relational, q_retrieval,  # noqa: F401
               q_questions, q_runs, q_screening, q_streaming)
from .registry import ORACLE, QUERIES

__all__ = ["QUERIES", "ORACLE"]
