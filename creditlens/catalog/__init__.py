"""Named queries over the supplied tables, with the SQL that states the same result."""

from creditlens.catalog import check_queries, column_queries, model_queries, report_queries, source_queries
from creditlens.catalog.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "check_queries", "column_queries", "model_queries", "report_queries", "source_queries"]
