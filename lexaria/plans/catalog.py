"""All queries of the library and their equivalent SQL."""

from __future__ import annotations

from lexaria.plans import corpus_queries, evaluation_queries, mechanism_queries, model_queries, rewrite_queries, stat_oracles, stat_queries, study_queries, surface_queries, text_queries

MODULES = (text_queries, evaluation_queries, corpus_queries, study_queries, stat_queries, rewrite_queries, model_queries, mechanism_queries, surface_queries)
QUERIES = {k: q for m in MODULES for k, q in m.QUERIES.items()}
ORACLES = {k: s for m in (*MODULES, stat_oracles) for k, s in m.ORACLES.items()}
