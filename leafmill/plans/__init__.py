"""The registered queries of the library and their SQL, by topic."""

from leafmill.plans import entities, jobs, layout, markdown, records, retrieval, stores

_TOPICS = (jobs, markdown, retrieval, entities, layout, records, stores)
QUERIES = {name: f for topic in _TOPICS for name, f in topic.QUERIES.items()}
ORACLES = {name: sql for topic in _TOPICS for name, sql in topic.ORACLES.items()}
