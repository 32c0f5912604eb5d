"""All registered queries and the SQL that gives the same rows."""

from . import w1, w2, w3, w4, w5, w6, w7

QUERIES: dict = {}
ORACLE_SQL: dict = {}
for _part in (w1, w2, w3, w4, w5, w6, w7):
    QUERIES |= _part.QUERIES
    ORACLE_SQL |= _part.SQL
