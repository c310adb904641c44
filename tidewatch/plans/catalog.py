"""All queries of the motion engine by name, and the SQL each must agree with."""

from __future__ import annotations

from . import motion_queries, reader_queries, recorder_queries

QUERIES = motion_queries.QUERIES | recorder_queries.QUERIES | reader_queries.QUERIES
ORACLE_SQL = motion_queries.ORACLE_SQL | recorder_queries.ORACLE_SQL | reader_queries.ORACLE_SQL
