"""All queries of the core, and their SQL counterparts."""

from evidelta.plans import evidence, quality, runs, sourcing

FLAGSHIP = "gate_summary"
QUERIES = {**runs.QUERIES, **evidence.QUERIES, **sourcing.QUERIES, **quality.QUERIES}
SQL = {**runs.SQL, **evidence.SQL, **sourcing.SQL, **quality.SQL}
