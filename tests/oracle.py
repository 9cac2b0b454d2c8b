"""Run registered queries next to their SQL on the same tables and compare.

    python tests/oracle.py [sf_dir] [name prefix ...]
"""

from __future__ import annotations

import os
import sys
import time
from decimal import Decimal

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, Decimal):
        return float(value)
    if isinstance(value, list):
        return tuple(_plain(v) for v in value)
    return value


def _sorted(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(plain, key=lambda r: tuple((v is None, str(type(v)), str(v)) for v in r))


# type families the two engines should agree on
def _family(kind: str) -> str:
    kind = kind.lower()
    for family, words in {
        "bigint": ["bigint"], "int": ["int", "integer"], "double": ["double"],
        "string": ["string", "varchar"], "time": ["timestamp", "timestamp_ntz"],
        "bool": ["boolean"],
    }.items():
        if kind in words:
            return family
    return kind


def compare(spark, con, sf_dir: str, name: str, fn, sql: str | None) -> str | None:
    """None if equal, else what differs."""
    df = fn(spark, sf_dir)
    names, rows = _sorted(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return None if names else "no columns"
    rel = con.sql(sql)
    theirs, want = _sorted(rel.columns, rel.fetchall())
    if names != theirs:
        return f"columns {names} / {theirs}"
    kinds = {f.name: _family(f.dataType.simpleString()) for f in df.schema.fields}
    their_kinds = {c: _family(str(k)) for c, k in zip(rel.columns, rel.types)}
    if kinds != their_kinds:
        return f"types { {c: (kinds[c], their_kinds[c]) for c in kinds if kinds[c] != their_kinds[c]} }"
    if len(rows) != len(want):
        return f"{len(rows)} rows / {len(want)}"
    for mine, other in zip(rows, want):
        if mine != other:
            return f"row {names}\n   spark {str(mine)[:600]}\n   sql   {str(other)[:600]}"
    return None if rows else "empty on both sides"


def main() -> int:
    import __spark_entry__ as entry
    from tidemark.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark, con = local_session("oracle"), connect(sf_dir)
    sqls, failed, without = entry.oracle_sql(), 0, []
    for name, fn in entry.queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        started = time.time()
        try:
            problem = compare(spark, con, sf_dir, name, fn, sqls.get(name))
        except Exception as exc:  # report and go on
            problem = f"{type(exc).__name__}: {str(exc)[:900]}"
        if name not in sqls:
            without.append(name)
        failed += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {time.time() - started:6.2f}s {name}"
              f"{'' if problem is None else ': ' + problem}", flush=True)
    print(f"{failed} failed; without SQL: {without}")
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main())
