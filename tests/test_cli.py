"""The command line runs the ingest and scoring jobs end to end."""

import glob
import tempfile

from pyspark.sql import functions as F

from contactlift.__main__ import main
from contactlift.plans import fixtures as FX
from contactlift.sources import files as IO
from paths import SF_SMALL


def test_cli_ingest_and_score(spark, capsys):
    work = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    snap = FX.snapshot(spark, SF_SMALL).withColumnRenamed("fecha", "Visa_fechaalta")
    IO.sink_delimited(snap, work + "/src")
    main(["--master", "local[2]", "ingest", work + "/src", work + "/ingested"])
    months = IO.scan_columnar(spark, work + "/ingested/months")
    assert months.count() == snap.count()

    cards = FX.cards(spark, SF_SMALL)
    cards.write.parquet(work + "/train")
    cards.drop("clase").write.parquet(work + "/apply")
    main(["--master", "local[2]", "score", work + "/train", work + "/apply", work + "/out", "--rounds", "3"])
    ranked = spark.read.option("sep", "\t").option("header", True).option("lineSep", "\r\n").csv(work + "/out/ranked")
    assert ranked.count() == cards.count()
    probs = [float(r["prob_positivo"]) for r in ranked.collect()]
    assert probs == sorted(probs, reverse=True)
    importance = glob.glob(work + "/out/importance/part-*")
    assert importance and all(x.endswith("\r") for p in importance for x in open(p, newline="").read().split("\n")[:-1])
    ids = spark.read.option("lineSep", "\r\n").csv(work + "/out/ids")
    assert ids.count() == ranked.where(F.col("prob_positivo").cast("double") > 0.025).count()
