"""All registered queries and their SQL twins."""

from __future__ import annotations

from setspan.plans import (
    analysis_plans,
    catalog_plans,
    file_plans,
    gsea_plans,
    idmap_plans,
    ora_plans,
    result_plans,
    source_plans,
)

_MODULES = (
    ora_plans, gsea_plans, idmap_plans, catalog_plans, result_plans, file_plans, analysis_plans,
    source_plans,
)

QUERIES = {name: query for module in _MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
