"""Compare every registered query with its DuckDB oracle (the driver's correctness gate, locally)."""

from __future__ import annotations

import math
import sys
import time

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return float(v)
    if hasattr(v, "item"):
        return _norm(v.item())
    try:
        if pd.isna(v):
            return None
    except (TypeError, ValueError):
        pass
    return v


def rows_of(pdf: pd.DataFrame) -> list[tuple]:
    cols = sorted(pdf.columns)
    out = [tuple(_norm(v) for v in row) for row in pdf[cols].itertuples(index=False, name=None)]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def same(a: list[tuple], b: list[tuple], rel: float = 1e-9) -> tuple[bool, str]:
    if len(a) != len(b):
        return False, f"rows {len(a)} vs {len(b)}"
    for i, (x, y) in enumerate(zip(a, b)):
        for u, v in zip(x, y):
            if isinstance(u, float) or isinstance(v, float):
                if u is None or v is None:
                    if u is not v:
                        return False, f"row {i}: {x} vs {y}"
                elif not math.isclose(float(u), float(v), rel_tol=rel, abs_tol=1e-12):
                    return False, f"row {i}: {x} vs {y}"
            elif u != v and not (isinstance(u, (int, float)) and isinstance(v, (int, float)) and u == v):
                return False, f"row {i}: {x} vs {y}"
    return True, ""


def check(spark, sf_dir: str, names=None, verbose=True) -> dict[str, str]:
    sys.path.insert(0, "/root/repo")
    import __spark_entry__ as E

    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    results = {}
    for name in names or sorted(sqls):
        t = time.time()
        try:
            sp = qs[name](spark, sf_dir).toPandas()
            dk = con.execute(sqls[name]).df()
            if sorted(sp.columns) != sorted(dk.columns):
                results[name] = f"columns {sorted(sp.columns)} vs {sorted(dk.columns)}"
            else:
                ok, why = same(rows_of(sp), rows_of(dk))
                results[name] = "ok" if ok else why
        except Exception as e:  # report and go on
            results[name] = f"error: {type(e).__name__}: {str(e)[:400]}"
        if verbose:
            print(f"{name:28s} {time.time() - t:6.2f}s {results[name][:300]}", flush=True)
    return results


if __name__ == "__main__":
    sys.path.insert(0, "/root/repo")
    from contactlift.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2].split(",") if len(sys.argv) > 2 else None
    spark = build_session()
    res = check(spark, sf, names)
    bad = {k: v for k, v in res.items() if v != "ok"}
    print(f"{len(res) - len(bad)}/{len(res)} ok")
