"""Compare a registered query with its SQL check on the same Parquet files."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


#: Spark type -> the DuckDB type a check must return
SAME = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "date": "DATE",
    "boolean": "BOOLEAN",
}


def _plain(v):
    if v is None or isinstance(v, str | bool | dt.date):
        return v
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def spark_rows(df):
    cols = sorted(df.columns)
    types = {c: SAME.get(t, t) for c, t in df.dtypes}
    return cols, types, Counter(tuple(_plain(r[c]) for c in cols) for r in df.collect())


def duck_rows(con, sql: str):
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    cols = sorted(names)
    at = [names.index(c) for c in cols]
    return cols, types, Counter(tuple(_plain(r[i]) for i in at) for r in cur.fetchall())


def differences(df, con, sql: str) -> list[str]:
    cols, types, got = spark_rows(df)
    dcols, dtypes, want = duck_rows(con, sql)
    out = []
    if cols != dcols:
        return [f"columns differ: {cols} / {dcols}"]
    odd = {c: (types[c], dtypes[c]) for c in cols if types[c] != dtypes[c]}
    if odd:
        out.append(f"types differ: {odd}")
    if got != want:
        extra, missing = got - want, want - got
        out.append(
            f"rows {sum(got.values())} / {sum(want.values())}, only Spark {sum(extra.values())}: "
            f"{list(extra)[:3]}, only SQL {sum(missing.values())}: {list(missing)[:3]} ({cols})"
        )
    elif not got:
        out.append("no rows on either side")
    return out
