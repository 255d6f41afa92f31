"""Every query of the core."""

from __future__ import annotations

from leafmill.plans import core_queries, nested_queries, page_queries, report_queries, source_queries
from leafmill.plans.queries import Registry

REGISTRY = Registry()
for _r in (core_queries.REGISTRY, nested_queries.REGISTRY, page_queries.REGISTRY, report_queries.REGISTRY, source_queries.REGISTRY):
    REGISTRY.queries.update(_r.queries)
    REGISTRY.sql.update(_r.sql)
