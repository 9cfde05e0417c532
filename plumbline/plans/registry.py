"""Every query over the given tables, and the SQL that gives the same rows."""

from plumbline.plans import decision_queries, detail_queries, extra_queries, more_queries, pair_queries, review_queries, text_queries, vector_queries

QUERIES: dict = {**text_queries.QUERIES, **vector_queries.QUERIES, **review_queries.QUERIES, **more_queries.QUERIES, **extra_queries.QUERIES, **detail_queries.QUERIES, **decision_queries.QUERIES, **pair_queries.QUERIES}
ORACLES: dict = {**text_queries.ORACLES, **vector_queries.ORACLES, **review_queries.ORACLES, **more_queries.ORACLES, **extra_queries.ORACLES, **detail_queries.ORACLES, **decision_queries.ORACLES, **pair_queries.ORACLES}
