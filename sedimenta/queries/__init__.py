"""Registered queries over the driver's tables, and the DuckDB SQL that each is held against."""

from __future__ import annotations

from sedimenta.queries import files, loading, names, parsing, parts, physical, profiles, records, relate, reports, rulebook, rules, scalars, sheets, streams, structures, texts

FLAGSHIP = "profile_orders_fields"
_AREAS = (profiles, relate, rules, rulebook, loading, records, parsing, reports, scalars, names, texts, files, structures, sheets, parts, physical, streams)
QUERIES = {name: q for area in _AREAS for name, q in area.QUERIES.items()}
ORACLE_SQL = {name: sql for area in _AREAS for name, sql in area.ORACLE_SQL.items()}
