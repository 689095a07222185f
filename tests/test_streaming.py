"""The stateless enrichment gives the same rows on a stream as in batch."""

import tempfile

from contactlift.plans import fixtures as FX
from contactlift.streaming.enrich import enrich_stream, start_enrichment
from paths import SF_SMALL


def test_stream_equals_batch(spark):
    src = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    out = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    wide = FX.wide(spark, SF_SMALL)
    wide.repartition(3).write.mode("overwrite").parquet(src + "/in")
    q = start_enrichment(spark, src + "/in", wide.schema, out + "/out", packs=("std",), month_col="none",
                         checkpoint=out + "/ck", available_now=True)
    q.awaitTermination(120)
    got = spark.read.parquet(out + "/out")
    want = enrich_stream(wide, ("std",), "none")
    assert got.count() == want.count()
    cols = ["id_cliente", "mv_msaldototal", "mv_mlimitecompra"]
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))
