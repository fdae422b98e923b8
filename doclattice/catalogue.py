"""All registered queries of the engine's own operators and their oracle SQL."""

from .plans import assets, corpus, diagnosis, formats, ingestion, scalars, search, streams  # noqa: F401

QUERIES: dict = {**corpus.QUERIES, **search.QUERIES, **assets.QUERIES}
ORACLE_SQL: dict[str, str] = {**corpus.ORACLE_SQL, **search.ORACLE_SQL, **assets.ORACLE_SQL}
