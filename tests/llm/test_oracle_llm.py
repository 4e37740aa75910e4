"""Queries against their SQL twins on whole tables."""

import duckdb
import pytest
from replysift.llm.oracle import ORACLE_SQL
from replysift.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    con.execute(f"CREATE VIEW labels AS SELECT * FROM read_parquet('{SF}/labels.parquet')")
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{SF}/embeddings.parquet')")
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    made = con.execute(ORACLE_SQL[name])
    columns = [d[0] for d in made.description]
    want = sorted(map(str, made.fetchall()))
    out = QUERIES[name](spark, SF)
    assert sorted(out.columns) == sorted(columns)
    assert sorted(str(tuple(r)) for r in out.select(*columns).collect()) == want


def test_mixing_with_many_shards(spark, monkeypatch):
    """The SQL twin with several shards for each source."""
    from replysift.llm import mixing, oracle

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    sql = ORACLE_SQL["op2_mixing"].replace(f"+ {oracle.DOCS_PER_SHARD} - 1) // {oracle.DOCS_PER_SHARD}", "+ 3 - 1) // 3")
    assert sql != ORACLE_SQL["op2_mixing"]
    want = sorted(con.execute(sql).fetchall(), key=str)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = mixing.mix_sources(mixing.sized(docs), docs_per_shard=3).select("doc_id", "size", "source_size", "target", "taken")
    assert sorted(map(tuple, out.collect()), key=str) == want
