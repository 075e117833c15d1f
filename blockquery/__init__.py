"""One analytic query as a set of clauses, and tables of facts about pipeline scripts, on Spark."""

from blockquery.operators.joins import Join
from blockquery.plans.block import query_block
from blockquery.sources.tables import catalog_tables, parquet_tables

__all__ = ["Join", "catalog_tables", "parquet_tables", "query_block"]
