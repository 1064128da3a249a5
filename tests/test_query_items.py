"""Queries that name the item behind a row, on items that share user and text."""

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry_module


def test_the_inserted_row_names_its_own_item(spark, tmp_path):
    """Items 4 and 6 share user and text; item 4 is near the inserted item 2, so item 6 is the inserted one."""
    texts = ["a", "b", "c", "d", "same", "e", "same", "f"]
    vectors = [[float(i == j) for j in range(8)] for i in (0, 1, 2, 3, 2, 5, 6, 7)]
    docs = {"doc_id": list(range(8)), "text": texts, "lang": ["fr"] * 8, "source": ["src9"] * 8}
    pq.write_table(pa.table(docs), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"vec_id": list(range(8)), "embedding": pa.array(vectors, pa.list_(pa.float32()))}),
                   tmp_path / "embeddings.parquet")
    got = {tuple(r) for r in entry_module.queries()["remember_batch_skip_near"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{tmp_path}/{t}.parquet'")
    assert got == set(con.execute(entry_module.oracle_sql()["remember_batch_skip_near"]).fetchall())
    assert 6 in {r[1] for r in got} and 4 not in {r[1] for r in got}
