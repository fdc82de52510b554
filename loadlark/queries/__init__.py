"""Registered queries of the library, each with its DuckDB SQL."""

from . import dispatch, documents, events, layout, links, market, memory, notes, pages, stops, tables

FAMILIES = (market, memory, events, notes, layout, links, stops, pages, documents, dispatch, tables)
QUERIES = {name: query for family in FAMILIES for name, query in family.QUERIES.items()}
ORACLES = {name: sql for family in FAMILIES for name, sql in family.ORACLES.items()}
