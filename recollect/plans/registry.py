"""All queries over the standard tables."""

from __future__ import annotations

from recollect.plans import fact_queries, search_queries, service_queries, steward_queries, stream_queries, text_queries, time_queries  # noqa: F401
from recollect.plans.register import FLAGSHIP, ORACLES, QUERIES  # noqa: F401
