"""All registered queries and their SQL."""

from __future__ import annotations

from tessera.plans import codec_queries, metric_queries, parity_queries, rate_queries, retrieval_queries, vq_queries  # noqa: F401  (they register themselves)
from tessera.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401
