"""Queries over the provided tables, by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from voxloom.plans import q_map, q_objects, q_stream, q_view

QUERIES: dict = q_map.QUERIES | q_view.QUERIES | q_objects.QUERIES | q_stream.QUERIES
ORACLES: dict[str, str] = q_map.ORACLES | q_view.ORACLES | q_objects.ORACLES | q_stream.ORACLES
