"""Queries on keys as large tables have them, against their SQL in DuckDB."""

import duckdb
import pytest

from terrier.plans import catalogue

from .test_queries import SF, ordered

#: A table's key and how far it is shifted.
FAR = {"join_candidate_ladder": ("part", "p_partkey", 79_400), "map_index_parse": ("customer", "c_custkey", 5_399_880)}


@pytest.mark.parametrize("name", sorted(FAR))
def test_far_keys(spark, tmp_path, name):
    table, key, far = FAR[name]
    con = duckdb.connect()
    con.execute(f"COPY (SELECT * REPLACE ({key} + {far} AS {key}) FROM '{SF}/{table}.parquet') TO '{tmp_path}/{table}.parquet'")
    con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet'")
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    result = con.execute(catalogue.ORACLE_SQL[name])
    assert ordered([tuple(r) for r in df.collect()], df.columns) == ordered(result.fetchall(), [c[0] for c in result.description])
