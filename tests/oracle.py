"""Compare a query with its SQL, as multisets of rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def run_sql(sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    rel = con.execute(sql)
    return [d[0] for d in rel.description], rel.fetchall()


def same(df, sql, sf_dir):
    names, want = run_sql(sql, sf_dir)
    assert sorted(names) == sorted(df.columns)
    plain = lambda x: round(x, 6) if isinstance(x, float) and math.isfinite(x) else x
    got = [tuple(plain(r[n]) for n in sorted(names)) for r in df.collect()]
    want = [tuple(plain(r[names.index(n)]) for n in sorted(names)) for r in want]
    assert sorted(got, key=repr) == sorted(want, key=repr)
