"""All queries of the volume-correlation engine by name, with their SQL twins."""

from __future__ import annotations

from corrvox.plans import queries_cases, queries_cells, queries_fields, queries_geometry, queries_metrics, queries_plan, queries_points, queries_samples, queries_solver, queries_text, queries_volumes, registry  # noqa: F401


def queries() -> dict:
    return dict(registry.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registry.SQL)
