"""All checked queries, by name, and the SQL that must give the same rows."""

from . import aggregates, flows, joins, retrieval, sources, tables, telemetry, texts

_ALL = (sources, joins, aggregates, texts, retrieval, telemetry, tables, flows)
QUERIES = {name: query for module in _ALL for name, query in module.checks.queries.items()}
SQL = {name: text for module in _ALL for name, text in module.checks.sql.items()}
