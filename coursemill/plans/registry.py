"""All registered queries with their SQL, gathered from the modules that define them."""

from __future__ import annotations

from coursemill.plans import catalog_queries, course_queries, job_queries, outline_queries, text_queries
from coursemill.plans.tables import ORACLES, QUERIES

FLAGSHIP = "file_map_topics"
MODULES = [text_queries, catalog_queries, course_queries, outline_queries, job_queries]

__all__ = ["FLAGSHIP", "MODULES", "ORACLES", "QUERIES"]
