"""Registered queries over the given tables, and their DuckDB SQL."""

from __future__ import annotations

from concordat.plans import queries, reviewing

FLAGSHIP = queries.FLAGSHIP
QUERIES = queries.QUERIES | reviewing.QUERIES
ORACLES = queries.ORACLES | reviewing.ORACLES
