"""Registered queries over the given tables, and their SQL twins."""

from rulewell.workload import (  # noqa: F401
    q_cleaning,
    q_parsing,
    q_rendering,
    q_reports,
    q_reshape,
    q_retrieval,
    q_scoring,
    q_sources,
)
