"""Runs a registered query and its SQL, and compares names and rows."""

from pathlib import Path

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


def compare(spark, name, d):
    import __spark_entry__ as entry
    import duckdb

    df = entry.queries()[name](spark, d)
    names = sorted(df.columns)
    got = sorted((tuple(plain(x) for x in r) for r in df.select(*names).collect()), key=repr)
    con = duckdb.connect()
    for t in TABLES:
        p = Path(d, f"{t}.parquet")
        if p.exists():
            con.execute(f"create view {t} as select * from read_parquet('{p}/*.parquet')" if p.is_dir() else f"create view {t} as select * from read_parquet('{p}')")
    made = con.execute(entry.oracle_sql()[name])
    order = sorted(range(len(made.description)), key=lambda i: made.description[i][0])
    assert [made.description[i][0] for i in order] == names
    want = sorted((tuple(plain(r[i]) for i in order) for r in made.fetchall()), key=repr)
    assert got == want
    return got
