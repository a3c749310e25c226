"""Operators for training-data pipelines. Nothing else in the library imports this package.

``QUERIES`` has one query for each operator, ``ORACLE_SQL`` the DuckDB SQL of those that SQL can express.
"""

from sigloom.llm import ann, bpe, clusters, decontaminate, divergence, fingerprints, html_text, langid, ngram_join, pii, secrets, sharding, urls

_MODULES = (decontaminate, langid, ngram_join, bpe, secrets, sharding, urls, ann, html_text, pii, divergence, clusters, fingerprints)
QUERIES = {k: q for m in _MODULES for k, q in m.QUERIES.items()}
ORACLE_SQL = {k: q for m in _MODULES for k, q in m.ORACLE_SQL.items()}
