"""Run registered queries against their SQL checks: python tools/check.py [sf] [name-prefix ...]"""

from __future__ import annotations

import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb                                                     # noqa: E402
from termsheet.plans import catalog, domain                       # noqa: E402
from termsheet.session import local_session                       # noqa: E402


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return 0.0 if value == 0 else float(f"{value:.12g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def connect(sf_dir: str):
    con = duckdb.connect()
    for name in domain.BASE_TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def compare(spark, con, sf_dir: str, name: str) -> tuple[bool, str]:
    started = time.time()
    df = catalog.QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    mine = Counter(tuple(plain(v) for v in row) for row in df.select(*[f"`{c}`" for c in columns]).collect())
    took = time.time() - started
    if name not in catalog.ORACLES:
        return True, f"{sum(mine.values())} rows, no SQL check, {took:.1f}s"
    cursor = con.execute(catalog.ORACLES[name])
    theirs_columns = [d[0] for d in cursor.description]
    if sorted(theirs_columns) != columns:
        return False, f"columns differ: {columns} / {sorted(theirs_columns)}"
    order = [theirs_columns.index(c) for c in columns]
    theirs = Counter(tuple(plain(row[i]) for i in order) for row in cursor.fetchall())
    if mine == theirs:
        types = {c: (df.schema[c].dataType.simpleString(), str(cursor.description[theirs_columns.index(c)][1])) for c in columns}
        odd = {c: t for c, t in types.items() if ("HUGEINT" in t[1].upper()) or ("DECIMAL" in t[1].upper())
               or (t[0] in ("bigint", "int")) != (t[1].upper() in ("BIGINT", "INTEGER"))}
        return True, f"{sum(mine.values())} rows, {took:.1f}s" + (f"  TYPES {odd}" if odd else "")
    a, b = list((mine - theirs).items())[:3], list((theirs - mine).items())[:3]
    return False, (f"{sum(mine.values())} vs {sum(theirs.values())} rows; differ {sum((mine - theirs).values())}/"
                   f"{sum((theirs - mine).values())}\n   cols {columns}\n   spark {a}\n   check {b}")


def main() -> int:
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.001"
    prefixes = sys.argv[2:]
    sf_dir = f"/root/testdata/sf{sf}"
    spark = local_session("check", 8)
    con = connect(sf_dir)
    bad = 0
    for name in catalog.QUERIES:
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            ok, note = compare(spark, con, sf_dir, name)
        except Exception as exc:                                  # report and go on
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:1500]}"
        bad += not ok
        print("ok  " if ok else "BAD ", name, note, flush=True)
    print("failed:", bad)
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
