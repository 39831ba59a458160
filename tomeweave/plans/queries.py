"""All queries of this package's own operators, and the SQL for them."""

from . import chunk_queries, corpus_queries, keyword_queries, note_queries, state_queries, vector_queries

MODULES = (corpus_queries, keyword_queries, vector_queries, chunk_queries, note_queries, state_queries)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: sql for module in MODULES for name, sql in module.SQL.items()}
