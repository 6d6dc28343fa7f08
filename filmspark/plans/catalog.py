"""Every query of the library's film operators over the test tables, with its SQL."""

from __future__ import annotations

from filmspark.plans import data_queries, film_queries, pixel_queries, scalar_queries, timeline_queries

_MODULES = (timeline_queries, scalar_queries, film_queries, data_queries, pixel_queries)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLES: dict[str, str] = {name: s for m in _MODULES for name, s in m.ORACLES.items()}
