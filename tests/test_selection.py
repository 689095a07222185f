"""Ranks and thresholds by hash prefix, against sorting in Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from contactlift.operators import sampling as S
from contactlift.operators import selection as SE


def _hash(seed, i):
    return hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest()


def _rows(n, repeat=0):
    rows = [(i, ["a", "b", None][0 if i % 3 else (i // 3) % 3]) for i in range(n)]
    return rows + [(7, "a")] * repeat


@pytest.mark.parametrize("few", [1, 5, SE.FEW])
@pytest.mark.parametrize("repeat", [0, 40])
def test_bounds_equal_a_sort(spark, few, repeat):
    rows = _rows(3000, repeat)
    df = spark.createDataFrame(rows, "id long, s string").repartition(5).withColumn(SE.HASH, F.md5(F.concat(F.lit("3:"), F.col("id"))))
    for fraction in (0.0, 0.001, 0.31, 1.0):
        got = {r["s"]: (r["__bh"], r["__bid"]) for r in SE.quota_bounds(
            df, ["s"], "id", S.stratum_quota(F.col("__n"), fraction), few).collect()}
        want = {}
        for s in {r[1] for r in rows}:
            order = sorted((_hash(3, i), i) for i, t in rows if t == s)
            q = round(len(order) * fraction)
            if q:
                want[s] = order[q - 1]
        assert got == want


@pytest.mark.parametrize("shared", [1, 20, SE.SHARED])
def test_ranks_equal_a_sort(spark, shared):
    rows = _rows(2000, 3)
    df = spark.createDataFrame(rows, "id long, s string").repartition(5).withColumn(SE.HASH, F.md5(F.concat(F.lit("3:"), F.col("id"))))
    got = sorted((r["id"], str(r["s"]), r["__rn"]) for r in SE.hash_ranks(df, ["s"], "id", shared=shared).collect())
    want = []
    for s in {r[1] for r in rows}:
        order = sorted((_hash(3, i), i) for i, t in rows if t == s)
        want += [(i, str(s), order.index((h, i)) + 1) for h, i in order]
    assert got == sorted(want)


def test_folds_keep_wide_rows_and_repeated_ids_together(spark):
    rows = [(i, "a" if i % 9 else "b", float(i)) for i in range(500)] + [(5, "a", -1.0), (5, "a", -2.0), (None, "a", 0.0)]
    df = spark.createDataFrame(rows, "id long, s string, x double").repartition(4)
    out = S.stratified_folds(df, 5, 11, ["s"], "id")
    assert out.columns == ["id", "s", "x", "fold"]
    got = out.collect()
    assert sorted((str(r["id"]), r["s"], r["x"]) for r in got) == sorted((str(i), s, x) for i, s, x in rows)
    assert len({r["fold"] for r in got if r["id"] == 5}) == 1
    sizes = [sum(r["fold"] == f and r["s"] == "b" for r in got) for f in range(5)]
    assert max(sizes) - min(sizes) <= 1
    empty = S.stratified_folds(df.where("id < 0"), 5, 11, ["s"], "id")
    assert empty.count() == 0
    assert S.stratified_sample(df.where("id < 0"), 0.5, ["s"], id_col="id").count() == 0


def test_plans_sort_no_ranges(spark):
    df = spark.range(5000).withColumn("s", (F.col("id") % 3).cast("string"))
    for out in (S.stratified_sample(df, 0.4, ["s"], id_col="id"), S.stratified_folds(df, 5, 1, ["s"], "id")):
        assert "rangepartitioning" not in out._jdf.queryExecution().toString().lower()
