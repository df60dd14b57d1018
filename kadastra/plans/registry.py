"""The registered queries of the listing engine and their SQL twins."""

from kadastra.plans import catalogue_data, catalogue_lists, catalogue_more, catalogue_search, catalogue_sources, catalogue_state, catalogue_streams

MODULES = (catalogue_search, catalogue_data, catalogue_state, catalogue_more, catalogue_sources, catalogue_streams, catalogue_lists)
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in MODULES for k, v in m.ORACLE_SQL.items()}
