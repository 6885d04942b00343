"""Registered queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.plans import answer_queries, script_queries, search_queries, store_queries, table_queries, text_queries

Query = Callable[[SparkSession, str], DataFrame]


def widened(query: Query) -> Query:
    """The query with its int columns as bigint, as SQL counts and ranks are."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        df = query(spark, folder)
        return df.select(*[F.col(f"`{c}`").cast("long").alias(c) if kind == "int" else F.col(f"`{c}`") for c, kind in df.dtypes])

    run.__name__ = query.__name__
    return run


_ALL = text_queries.QUERIES | search_queries.QUERIES | table_queries.QUERIES | answer_queries.QUERIES | script_queries.QUERIES | store_queries.QUERIES
QUERIES: dict[str, Query] = {name: widened(query) for name, query in _ALL.items()}
ORACLES: dict[str, str] = text_queries.ORACLES | search_queries.ORACLES | table_queries.ORACLES | answer_queries.ORACLES | script_queries.ORACLES | store_queries.ORACLES
#: Table columns of type int that these queries return; widened as above.
_INTS = {"cosine_label_precision": "own", "vector_norms": "label", "crosscheck_agreement": "ours", "first_seen": "l_linenumber", "map_edit": "n_nationkey", "union_by_name": "nation", "rollup_revenue": "n_regionkey"}
for _name, _column in _INTS.items():
    ORACLES[_name] = f"SELECT * REPLACE (CAST({_column} AS BIGINT) AS {_column}) FROM ({ORACLES[_name]})"
