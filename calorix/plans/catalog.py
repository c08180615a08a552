"""All domain queries and their DuckDB oracles, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from calorix.plans import energy_queries, entity_queries, mesh_queries, reader_queries, scene_queries, sight_queries, site_queries, weather_queries

MODULES = (weather_queries, mesh_queries, sight_queries, energy_queries, scene_queries, entity_queries, reader_queries, site_queries)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {n: q for m in MODULES for n, q in m.QUERIES.items()}
ORACLES: dict[str, str] = {n: s for m in MODULES for n, s in m.ORACLES.items()}
