"""Rows of a DataFrame and of DuckDB SQL in one form."""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(x):
    import datetime
    import decimal

    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, decimal.Decimal):
        return float(x)
    if isinstance(x, (list, tuple)):
        return [_plain(y) for y in x]
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


def rows_of(df):
    cols = sorted(df.columns)
    return cols, sorted(repr([_plain(r[c]) for c in cols]) for r in df.collect())


def duck_rows(sql, sf_dir):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cur = c.execute(sql)
    names = [d[0] for d in cur.description]
    cols = sorted(names)
    at = [names.index(x) for x in cols]
    return cols, sorted(repr([_plain(r[i]) for i in at]) for r in cur.fetchall())
