"""Queries over the retail roles."""

from . import finding_queries, nba_queries, quality_queries, question_queries, reco_queries, serving_queries, stream_queries  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
