"""The registered queries of the transcript engine, and their SQL."""

from __future__ import annotations

from . import aggregates, artifacts, kernels, samples, sets, streams  # noqa: F401  their queries register on import
from .registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
