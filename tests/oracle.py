"""Compares a query's rows with its SQL in DuckDB, as multisets."""

import os

import duckdb


def same_rows(spark, sf_dir: str, query, sql: str) -> None:
    got = query(spark, sf_dir).toArrow()
    db = duckdb.connect()
    for f in os.listdir(sf_dir):
        if f.endswith(".parquet"):
            db.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf_dir}/{f}'")
    want = db.execute(sql).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names)
    db.register("got", got)
    db.register("want", want)
    cols = ", ".join(f'"{c}"' for c in sorted(got.column_names))
    for a, b in (("got", "want"), ("want", "got")):
        assert db.execute(f"SELECT {cols} FROM {a} EXCEPT ALL SELECT {cols} FROM {b}").fetchall() == []
    assert got.num_rows == want.num_rows
