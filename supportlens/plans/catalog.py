"""All queries and their check SQL."""

from supportlens.plans import (  # noqa: F401
    profile_queries,
    retrieval_queries,
    stream_queries,
    support_queries,
    text_queries,
)
from supportlens.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
