"""Named queries over the site tables and their SQL counterparts."""

from __future__ import annotations

from sitemill.plans import addresses, catalogue, extraction, graphs, layouts, records, scalars, schedule, shop

_MODULES = [addresses, graphs, catalogue, schedule, records, shop, extraction, layouts, scalars]

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
