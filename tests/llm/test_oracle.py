"""The SQL of the training-data queries."""

import duckdb

import __spark_entry__
from topicwise.llm.queries import ORACLE

from .helpers import texts


def test_every_oracle_is_sql():
    assert {k for k, v in __spark_entry__.oracle_sql().items() if not isinstance(v, str)} == set()


def test_sql_runs():
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", [r for r in texts()[:9] if r[0] is not None])
    # The spelling query only lists words that occur at least five times; the texts above have none.
    con.execute("INSERT INTO documents VALUES (9001, ?)", ["planet " * 25 + "plamet " * 5])
    con.execute("CREATE TABLE benchmark AS SELECT 1 AS item_id, 'two words' AS text")
    con.execute("CREATE TABLE embeddings AS SELECT * FROM (VALUES (1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 1.0])) t(vec_id, embedding)")
    con.execute("CREATE TABLE pages AS SELECT 1 AS page_id, 'http://a' AS url, '<p>x</p>' AS html")
    for name, sql in ORACLE.items():
        assert con.execute(sql).fetchall(), name
