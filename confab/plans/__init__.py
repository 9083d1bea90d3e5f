"""The query catalogue: Spark plans and the SQL they are checked against."""

from confab.plans.catalogue import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
