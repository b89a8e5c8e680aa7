"""Every registered query of the engine, with DuckDB SQL for the same result."""

from __future__ import annotations

from . import files, frames, graphs, pixels, plans, scores, tiled, videos

_PARTS = (pixels, scores, graphs, plans, files, videos, frames, tiled)
QUERIES: dict = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES: dict = {name: sql for part in _PARTS for name, sql in part.ORACLES.items()}
