"""Comparison of a query's rows with those of its SQL in DuckDB."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame):
    def plain(v):
        if v is None or v is pd.NA or v != v:
            return None
        return round(float(v), 6) if isinstance(v, float) else (bool(v) if str(type(v)).find("bool") >= 0 else (int(v) if str(type(v)).find("int") >= 0 else v))

    columns = sorted(frame.columns)
    return sorted((tuple(plain(v) for v in r) for r in frame[columns].itertuples(index=False, name=None)), key=str)


def same(query, sql, spark, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    found, wanted = query(spark, sf_dir).toPandas(), con.execute(sql).df()
    assert sorted(found.columns) == sorted(wanted.columns)
    assert len(found) == len(wanted)
    a, b = rows(found), rows(wanted)
    assert a == b, [x for x in zip(a, b) if x[0] != x[1]][:3]
