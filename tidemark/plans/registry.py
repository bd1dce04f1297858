"""Every query of the time-series engine by name, with its SQL."""

from __future__ import annotations

from . import document_queries, formula_queries, grid_queries, ladder_queries, leak_queries, more_queries, order_queries, page_queries, series_queries, source_queries, uncertainty_queries

QUERIES = series_queries.QUERIES | more_queries.QUERIES | ladder_queries.QUERIES | grid_queries.QUERIES | source_queries.QUERIES | leak_queries.QUERIES | formula_queries.QUERIES | uncertainty_queries.QUERIES | document_queries.QUERIES | order_queries.QUERIES | page_queries.QUERIES
ORACLES = series_queries.ORACLES | more_queries.ORACLES | ladder_queries.ORACLES | grid_queries.ORACLES | source_queries.ORACLES | leak_queries.ORACLES | formula_queries.ORACLES | uncertainty_queries.ORACLES | document_queries.ORACLES | order_queries.ORACLES | page_queries.ORACLES
FLAGSHIP = QUERIES["crps_price_vs_baseline"]
