"""Compare a query with its SQL, as multisets of rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run_sql(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.isdir(path := f"{sf_dir}/{t}.parquet"):
            path += "/*.parquet"
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    rel = con.execute(sql)
    return [d[0] for d in rel.description], rel.fetchall()


def same(df, sql, sf_dir):
    names, want = run_sql(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    got = [tuple(r[n] for n in sorted(names)) for r in df.collect()]
    want = [tuple(r[names.index(n)] for n in sorted(names)) for r in want]
    assert len(got) == len(want)
    assert sorted(got, key=repr) == sorted(want, key=repr)
