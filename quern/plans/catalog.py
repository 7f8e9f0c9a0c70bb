"""The catalogue of queries: one module a theme, query and SQL side by side."""

from __future__ import annotations

from quern.plans import article_queries, index_queries, io_queries, pipeline, sample_queries, text_queries
from quern.registry import Registry

R = Registry()
for module in (article_queries, text_queries, index_queries, sample_queries, io_queries, pipeline):
    for name, query in module.R.queries.items():
        R.query(name, module.R.sql.get(name))(query)


def flagship(spark, d):
    """Articles, novels and documents filtered, cleaned, without exact copies, cut into chunks, neighbours paired, reported by source."""
    return pipeline.corpus_pipeline(spark, d)
