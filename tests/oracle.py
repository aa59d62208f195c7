"""Run registered queries beside their SQL and compare rows; ``python tests/oracle.py sf [name ...]``."""

from __future__ import annotations

import datetime as dt
import decimal
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def cell(v):
    if v is None:
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, decimal.Decimal):
        v = float(v) if v % 1 else int(v)
    if isinstance(v, float):
        return "nan" if v != v else repr(round(v, 6) + 0.0)
    if isinstance(v, (dt.datetime, dt.date)):
        return v.isoformat()
    return str(v)


def kind(t: str) -> str:
    t = t.lower()
    if t in ("double", "float", "real"):
        return "float"
    if t.startswith("decimal"):
        return "decimal"
    if t in ("int", "integer", "bigint", "smallint", "tinyint", "long"):
        return "int"
    if t in ("string", "varchar"):
        return "text"
    return t


def table(rows, columns) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet')")
    return con


def compare(spark, folder: str, name: str, fn, sql: str | None, con=None) -> tuple[bool, str]:
    t0 = time.time()
    df = fn(spark, folder)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - t0
    if sql is None:
        return True, f"{name}: {len(got)} rows, no SQL, {took:.1f}s"
    con = con or duck(folder)
    t1 = time.time()
    cur = con.execute(sql)
    names, kinds = [d[0] for d in cur.description], [kind(str(d[1])) for d in cur.description]
    want = cur.fetchall()
    sql_took = time.time() - t1
    left, right = table(got, df.columns), table(want, names)
    mine = {c: kind(t) for c, t in df.dtypes}
    problems = []
    if sorted(df.columns) != sorted(names):
        problems.append(f"columns {sorted(df.columns)} vs {sorted(names)}")
    elif any(mine[c] != k for c, k in zip(names, kinds)):
        problems.append(f"types {[(c, mine[c], k) for c, k in zip(names, kinds) if mine[c] != k]}")
    if left != right:
        extra, missing = list(set(left) - set(right))[:3], list(set(right) - set(left))[:3]
        problems.append(f"rows {len(left)} vs {len(right)}; only ours {extra}; only SQL {missing}")
    state = "ok" if not problems else "DIFFERS " + "; ".join(problems)
    return not problems, f"{name}: {len(got)} rows {took:.1f}s (sql {sql_took:.1f}s) {state}"


def main() -> None:
    import __spark_entry__ as entry
    from linkloom.session import local_session

    folder = f"/root/testdata/sf{sys.argv[1]}"
    spark = local_session("8")
    queries, sql = entry.queries(), entry.oracle_sql()
    wanted = [n for n in queries if not sys.argv[2:] or any(n.startswith(a) for a in sys.argv[2:])]
    con, bad = duck(folder), []
    for n in wanted:
        try:
            ok, text = compare(spark, folder, n, queries[n], sql.get(n), con)
        except Exception as e:  # report and go on
            ok, text = False, f"{n}: FAILED {type(e).__name__}: {str(e)[:600]}"
        print(text, flush=True)
        bad += [] if ok else [n]
    print(f"{len(wanted) - len(bad)} of {len(wanted)} fine; not fine: {bad}")


if __name__ == "__main__":
    main()
