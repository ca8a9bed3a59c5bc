"""All queries of the library by name, and their SQL twins."""

from __future__ import annotations

from . import cleaning, curation, harvest, interactive, linkage, mentions, records, timelines

_PARTS = (interactive, timelines, records, curation, cleaning, linkage, harvest, mentions)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
SQL = {name: sql for part in _PARTS for name, sql in part.SQL.items()}
