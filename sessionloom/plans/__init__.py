"""Queries of every operator on the driver's tables: QUERIES by name, ORACLE_SQL where SQL can express them."""

from . import attribution, encounters, identity, records, sources, timeline, transcript, vectors

_ALL = [sources, transcript, timeline, encounters, identity, vectors, records, attribution]
QUERIES = {k: v for m in _ALL for k, v in m.Q.items()}
ORACLE_SQL = {k: v for m in _ALL for k, v in m.S.items()}
