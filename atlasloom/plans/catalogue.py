"""Every registered query of the map engine, with the SQL that gives the same result.

The driver's tables stand in for map tables: `lineitem` for point clouds and volumes, `events` for sightings and time
series, `embeddings` for descriptors, `orders` for frames and metrics, `supplier` and `customer` for places.
"""

from __future__ import annotations

from atlasloom.plans import queries_adjustment, queries_aggregate, queries_checks, queries_contradictions, queries_fusion, queries_joins, queries_objects, queries_order, queries_places, queries_poses, queries_rules, queries_surfaces

QUERIES = {}
ORACLE_SQL = {}
for _module in (queries_aggregate, queries_joins, queries_order, queries_objects, queries_fusion, queries_rules, queries_checks, queries_poses, queries_places, queries_adjustment, queries_surfaces, queries_contradictions):
    QUERIES |= _module.QUERIES
    ORACLE_SQL |= _module.ORACLE_SQL
