"""Registered queries of the metadata operators and their DuckDB counterparts.

A query's name starts with the numbers of the operators that it runs. Queries without SQL are held against brute force by the tests.
"""

from citeweave.plans import queries_decide, queries_reports, queries_sources, queries_text  # noqa: F401
from citeweave.plans.registered import ORACLES, QUERIES, query  # noqa: F401
