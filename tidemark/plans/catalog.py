"""All queries over the driver's tables and their SQL."""

from __future__ import annotations

from tidemark.plans import analyses, breakdowns, features, filing, marts, peers, quality, ranking, restated, staging, suite  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES  # noqa: F401
