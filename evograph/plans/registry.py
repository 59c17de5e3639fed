"""Registered queries and their SQL."""

from evograph.plans import q_agg, q_graph, q_join, q_scan, q_stream

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _module in (q_scan, q_join, q_agg, q_graph, q_stream):
    QUERIES.update(_module.QUERIES)
    ORACLE_SQL.update(_module.SQL)
