"""The queries and SQL of this package."""

from marquee.llm import alignment, embeddings, langid, maintext, mixing, packing, pii, quality, sharding, simhash, spelling, suffixtree, urls

MODULES = (simhash, mixing, embeddings, urls, sharding, pii, packing, langid, suffixtree, quality, maintext, spelling, alignment)
QUERIES = {name: query for m in MODULES for name, query in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in MODULES for name, sql in m.ORACLE_SQL.items()}
