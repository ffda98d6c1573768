"""The queries of this subpackage and their SQL counterparts."""

from evidelta.llm.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
