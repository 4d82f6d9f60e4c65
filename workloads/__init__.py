"""Queries over the supplied tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from workloads import (  # noqa: F401
    evaluation,
    features,
    flattening,
    inventories,
    joins,
    labels,
    models,
    quality,
    runs,
    storage,
)
from workloads.registry import ORACLES, QUERIES  # noqa: F401
