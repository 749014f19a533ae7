"""All registered queries: importing the modules registers them."""

from planweave.plans import check_queries, commit_queries, dependency_queries, integrity_queries, nested_queries, rebuild_queries, schema_queries, snapshot_queries, uniqueness_queries  # noqa: F401
from planweave.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
