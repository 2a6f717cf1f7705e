"""All queries of the core by name, with their SQL."""

from trialloom.queries import cases, pipeline, problems, rerank, retrieval, texts

_LISTED = (texts.query, retrieval.query, pipeline.query, cases.query, rerank.query)
QUERIES = {**problems.QUERIES, **{k: q for listed in _LISTED for k, q in listed.queries.items()}}
SQL: dict[str, str] = {k: s for listed in _LISTED for k, s in listed.sql.items()}
