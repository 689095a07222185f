"""Readers, writers and the catalog."""

import tempfile

import pytest

from contactlift.plans import fixtures as FX
from contactlift.sources import files as IO
from paths import SF_SMALL


def test_gzip_tsv_is_read_transparently(spark):
    work = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    cust = FX.table(spark, SF_SMALL, "customer")
    cust.write.option("sep", "\t").option("header", True).option("compression", "gzip").csv(work + "/gz")
    back = IO.scan_delimited(spark, work + "/gz", schema=cust.schema)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cust.collect()))


def test_convert_many_files(spark):
    work = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    cust = FX.table(spark, SF_SMALL, "customer")
    nation = FX.table(spark, SF_SMALL, "nation")
    IO.sink_delimited(cust, work + "/c")
    IO.sink_delimited(nation, work + "/n")
    out = IO.convert_to_columnar(spark, {"c": work + "/c", "n": work + "/n"}, work + "/pq")
    assert IO.scan_columnar(spark, out["c"]).count() == cust.count()
    assert IO.scan_columnar(spark, out["n"]).count() == nation.count()


def test_catalog_views_and_unknown_name(spark):
    cat = IO.DatasetCatalog(spark).register("train", f"{SF_SMALL}/customer.parquet")
    assert cat.as_views() == ["train"]
    assert spark.table("train").count() == FX.table(spark, SF_SMALL, "customer").count()
    with pytest.raises(KeyError):
        cat.get_predict()


def test_table_shape(spark):
    cust = FX.table(spark, SF_SMALL, "customer")
    row = IO.table_shape(cust).first()
    assert row["n_rows"] == cust.count() and row["n_cols"] == len(cust.columns)
