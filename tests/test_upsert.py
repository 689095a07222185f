"""Monthly upsert, quarantine, and the catalog's statistics and schema check."""

import glob
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from contactlift.sources import files as IO

SCHEMA = "numero_de_cliente bigint, foto_mes int, Master_fechaalta int, x double"


def _work():
    return tempfile.mkdtemp(prefix="run-", dir="/tmp")


def _text(path, rows):
    os.makedirs(path)
    with open(path + "/part.txt", "w") as f:
        f.write("numero_de_cliente\tfoto_mes\tMaster_fechaalta\tx\n" + "".join("\t".join(r) + "\n" for r in rows))
    return path


def _files(path):
    return {p: os.stat(p).st_mtime_ns for p in glob.glob(path + "/**/part-*", recursive=True)}


def _rows(spark, path, *cols):
    return sorted(map(tuple, IO.scan_columnar(spark, path).select(*cols).collect()))


def test_second_delivery_replaces_its_month_only(spark):
    work = _work()
    first = [(str(i), m, "20190103", "0.5") for i in range(40) for m in ("201902", "201903")]
    paths = IO.upsert_snapshots(spark, _text(work + "/a", first), work + "/out", [201903], schema=SCHEMA)
    before = {k: _files(paths[k]) for k in ("raw", "months", "whole")}
    again = [("7", "201903", "20190301", ""), ("8", "201903", "", "2.5")]
    paths = IO.upsert_snapshots(spark, _text(work + "/b", again), work + "/out", [201903], schema=SCHEMA)
    for k, old in before.items():
        new = _files(paths[k])
        kept = {p: t for p, t in old.items() if "201902" in p}
        assert kept and kept.items() <= new.items()
        assert not any("201903" in p and p in new for p in old)
    got = _rows(spark, paths["months"], "numero_de_cliente", "foto_mes", "Master_fechaalta", "x")
    assert [r for r in got if r[1] == 201903] == [(7, 201903, 31, None), (8, 201903, None, 2.5)]
    assert sum(r[1] == 201902 for r in got) == 40
    raw = IO.scan_delimited(spark, paths["raw_201903"], SCHEMA)
    assert raw.columns[:2] == ["numero_de_cliente", "foto_mes"] and raw.count() == 2
    whole = IO.scan_delimited(spark, glob.glob(paths["whole"] + "/month=*"), SCHEMA)
    assert whole.count() == 42 and whole.where("foto_mes = 201903 and Master_fechaalta = 31").count() == 1
    latest = {r["month"]: r["n_rows"] for r in IO.read_manifest(spark, paths["manifest"], latest=True).collect()}
    assert latest == {201902: 40, 201903: 2}
    assert IO.read_manifest(spark, paths["manifest"]).count() == 3


def test_upsert_refuses_other_schemas_and_missing_months(spark):
    work = _work()
    df = spark.createDataFrame([(1, 201902, 1.0)], "numero_de_cliente bigint, foto_mes int, x double")
    IO.upsert_months(df, work + "/t", work + "/m")
    with pytest.raises(ValueError, match="schema differs"):
        IO.upsert_months(df.withColumn("x", F.lit("a")), work + "/t", work + "/m")
    with pytest.raises(ValueError, match="without foto_mes"):
        IO.upsert_months(df.withColumn("foto_mes", F.lit(None).cast("int")), work + "/t", work + "/m")
    IO.upsert_months(df.where("x > 5"), work + "/t", work + "/m")  # nothing delivered, nothing replaced
    assert _rows(spark, work + "/t", "numero_de_cliente", "x", "foto_mes") == [(1, 1.0, 201902)]


def test_quarantine_keeps_the_line_and_counts(spark):
    work = _work()
    rows = [("1", "201902", "", "0.5"), ("two", "201902", "", "1"), ("3", "201902"), ("4", "201902", "", "1", "more"),
            ("5", "201902", "20190101", "x"), ("", "", "", "0"), ("", "", "", "")]
    src = _text(work + "/a", rows)
    got = IO.parse_delimited(spark, src, work + "/p", SCHEMA)
    assert (got.n_rows, got.n_quarantined) == (2, 4)
    assert sorted(r["raw_line"] for r in got.quarantine.collect()) == sorted("\t".join(r) for r in rows[1:5])
    assert got.quarantine.where(F.col("source_file").endswith("/part.txt")).count() == 4
    assert sorted(map(tuple, got.rows.collect()), key=str) == [(1, 201902, None, 0.5), (None, None, None, 0.0)]  # a line of separators is no row
    clean = IO.parse_delimited(spark, _text(work + "/b", rows[:1]), work + "/q", SCHEMA)
    assert clean.n_quarantined == 0 and clean.quarantine.isEmpty() and clean.rows.count() == 1
    none = IO.parse_delimited(spark, _text(work + "/c", []), work + "/r", SCHEMA)
    assert (none.n_rows, none.n_quarantined) == (0, 0) and none.rows.columns == [c.split()[0] for c in SCHEMA.split(", ")]


def test_catalog_stores_statistics_and_checks_schemas(spark):
    work = _work()
    df = spark.createDataFrame([(1, float("nan"), "a"), (2, 3.0, None), (3, -1.0, "b")], "id int, x double, s string")
    cat = IO.DatasetCatalog(spark, root=work).store("train", df, "id int, x double, s string")
    want = [("id", 3, 0, 1.0, 3.0), ("s", 3, 1, None, None), ("x", 3, 1, -1.0, 3.0)]
    stats = cat.statistics("train").select("column", "n_rows", "n_missing", "lowest", "highest")
    assert sorted(map(tuple, stats.collect())) == want
    again = IO.DatasetCatalog(spark, root=work).register("train", work + "/train", "id int, x double, s string")
    assert again.statistics("train").count() == 3 and again.as_views() == ["train"]
    with pytest.raises(ValueError, match="x: double, expected int"):
        again.register("predict", work + "/train", "id int, x int, s string")
    assert "predict" not in again.paths
