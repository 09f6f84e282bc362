"""The registered queries of the library and their SQL."""

from locus_spark.queries import graphs, intervals, kernels, merging, paths, refined, statistics

_MODULES = (intervals, graphs, statistics, kernels, refined, merging, paths)

QUERIES: dict = {name: query for m in _MODULES for name, query in m.R.queries.items()}
ORACLE_SQL: dict = {name: sql for m in _MODULES for name, sql in m.R.sql.items()}
FLAGSHIP = "cov_mean_interval"
