"""Runs registered queries next to their SQL twin and compares whole results.

    python tests/oracle.py [sf] [name or prefix ...]
"""

from __future__ import annotations

import importlib
import math
import pathlib
import sys
import time

import duckdb
import pandas as pd

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return "~"
    if isinstance(v, float):
        if math.isnan(v):
            return "~"
        return repr(v + 0.0) if v != 0 else "0.0"
    if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
        v = v.tolist()
    if isinstance(v, list):
        return "[" + ",".join(canon(x) for x in v) + "]"
    return str(v)


def kind(dtype) -> str:
    return {"i": "int", "u": "int", "f": "float", "b": "bool", "M": "time"}.get(dtype.kind, "object")


def compare(left: pd.DataFrame, right: pd.DataFrame) -> list[str]:
    """Differences between two results as text; empty when equal."""
    a, b = sorted(left.columns), sorted(right.columns)
    if a != b:
        return [f"columns {a} vs {b}"]
    out = []
    if len(left) != len(right):
        out.append(f"rows {len(left)} vs {len(right)}")
    for c in a:
        if kind(left[c].dtype) != kind(right[c].dtype) and len(left):
            out.append(f"type of {c}: {left[c].dtype} vs {right[c].dtype}")
    rows_l = sorted("|".join(canon(v) for v in r) for r in left[a].itertuples(index=False))
    rows_r = sorted("|".join(canon(v) for v in r) for r in right[a].itertuples(index=False))
    if rows_l != rows_r:
        only_l = sorted(set(rows_l) - set(rows_r))[:3]
        only_r = sorted(set(rows_r) - set(rows_l))[:3]
        out.append(f"values [{'|'.join(a)}]\n   spark {only_l}\n   sql   {only_r}")
    return out


def main(argv: list[str]) -> int:
    from tallyhouse.session import get_session

    sf = argv[0] if argv else "0.01"
    wanted = argv[1:]
    sf_dir = f"/root/testdata/sf{sf}"
    import __spark_entry__ as entry

    spark = get_session(
        master="local[8]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    sql = entry.oracle_sql()
    bad = 0
    for section in [w[1:] for w in wanted if w.startswith("@")]:
        wanted += list(importlib.import_module(f"tallyhouse.checks.{section}").QUERIES)
    for name, fn in entry.queries().items():
        if wanted and not any(name == w or (w.endswith('*') and name.startswith(w[:-1])) for w in wanted):
            continue
        t0 = time.time()
        try:
            df = fn(spark, sf_dir).toPandas()
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: spark {str(exc)[:900]}")
            continue
        took = time.time() - t0
        if name not in sql:
            print(f"rows {name}: {len(df)} ({took:.1f}s)")
            continue
        try:
            twin = con.execute(sql[name]).fetchdf()
        except Exception as exc:  # noqa: BLE001
            bad += 1
            print(f"FAIL {name}: sql {str(exc)[:600]}")
            continue
        diff = compare(df, twin)
        bad += bool(diff)
        print(("FAIL " if diff else "ok   ") + f"{name}: {len(df)} rows ({took:.1f}s) " + "; ".join(diff)[:900])
    print("failures:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
