"""All registered queries of the library with their DuckDB equivalents."""

from __future__ import annotations

from .plans import q_eval, q_experiments, q_graph, q_paths, q_platform, q_text, q_vectors  # noqa: F401  importing registers
from .plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
