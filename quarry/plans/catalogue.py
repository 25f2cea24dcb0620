"""The registered queries of the catalog engine and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.plans import browsing, people, sources, state, tagging

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
for _part in (browsing, tagging, state, people, sources):
    QUERIES.update(_part.QUERIES)
    ORACLE.update(_part.ORACLE)
