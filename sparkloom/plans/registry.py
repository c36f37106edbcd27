"""All queries of the measurement operators by name, with their SQL."""

from __future__ import annotations

from . import contracts, discovery, evidence, expression, files, flow, graphs, niches, quality, ranking, screening, space, splits  # noqa: F401
from ._register import QUERIES, SQL

FLAGSHIP = "evidence_gated_ranking"

__all__ = ["FLAGSHIP", "QUERIES", "SQL"]
