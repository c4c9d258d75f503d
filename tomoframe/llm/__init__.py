"""Training-data operators: dedup, sharding, filtering, packing, encoding.

Nothing outside this folder imports it.  `registry.queries()` and
`registry.oracle_sql()` list the named queries.
"""
