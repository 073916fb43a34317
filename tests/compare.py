"""Run queries against their oracle SQL: python tests/compare.py SF_DIR [NAME...]"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_value(x) for x in v)
    return v


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    con.execute("SET timezone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        src = f"{p}/*.parquet" if p.is_dir() else str(p)
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{src}'")
    return con


def compare(spark, con, sf_dir: str, query, sql: str) -> str:
    """Empty when both give the same rows and columns, else what differs."""
    df = query(spark, sf_dir)
    cols = sorted(df.columns)
    mine = Counter(tuple(_value(r[c]) for c in cols) for r in df.collect())
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    if sorted(names) != cols:
        return f"columns {cols} against {sorted(names)}"
    at = [names.index(c) for c in cols]
    other = Counter(tuple(_value(r[i]) for i in at) for r in res.fetchall())
    if mine != other:
        return f"{sum(mine.values())} rows against {sum(other.values())}; only here {list((mine - other).items())[:3]}; only there {list((other - mine).items())[:3]}"
    return ""


def main() -> int:
    import __spark_entry__ as entry

    from lauda.session import local_session

    sf_dir, names = sys.argv[1], sys.argv[2:]
    os.environ["TZ"] = "UTC"
    time.tzset()
    spark, con, bad = local_session(), duck(sf_dir), 0
    queries, sqls = entry.queries(), entry.oracle_sql()
    for name in [n for n in queries if not names or n in names or any(n.startswith(x[:-1]) for x in names if x.endswith("*"))]:
        began = time.time()
        try:
            why = compare(spark, con, sf_dir, queries[name], sqls[name]) if name in sqls else f"(no SQL) {queries[name](spark, sf_dir).count()} rows"
        except Exception as e:  # report every query
            why = f"{type(e).__name__}: {str(e)[:1500]}"
        bad += bool(why) and not why.startswith("(no SQL)")
        print(f"{name}: {why or 'same'} [{time.time() - began:.1f} s]", flush=True)
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
