"""Feature packs on a stream of monthly snapshot files.

The reference has no streaming logic (no watermark, window or state). Its enrichment is a
stateless projection, so the same plan runs on a streaming DataFrame unchanged: new snapshot
files dropped into a folder are turned into day offsets and enriched, micro-batch by
micro-batch, and written out partitioned by month. The checkpoint of the stream lives under the
shared checkpoint folder, so a restarted query resumes from its last committed batch.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from contactlift.operators.packs import apply_pack
from contactlift.sources.files import dates_to_day_offsets


def enrich_stream(stream: DataFrame, packs: Sequence[str] = ("std",), month_col: str = "foto_mes") -> DataFrame:
    """Day offsets and feature packs on a (streaming or batch) snapshot DataFrame."""
    out = dates_to_day_offsets(stream, month_col) if month_col in stream.columns else stream
    for pack in packs:
        out = apply_pack(out, pack)
    return out


def start_enrichment(spark: SparkSession, source_dir: str, schema: StructType | str, sink_dir: str,
                     packs: Sequence[str] = ("std",), month_col: str = "foto_mes",
                     checkpoint: str | None = None, source_format: str = "parquet",
                     max_files_per_trigger: int = 8, available_now: bool = False) -> StreamingQuery:
    """Start a query that enriches every new snapshot file in ``source_dir`` into ``sink_dir``.

    Without ``checkpoint`` the progress is kept beside the sink, so a restart resumes where it stopped.
    """
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
    if source_format == "csv":
        reader = reader.option("sep", "\t").option("header", True).option("nullValue", "")
    stream = reader.format(source_format).load(source_dir)
    enriched = enrich_stream(stream, packs, month_col)
    writer = (enriched.writeStream.format("parquet").option("path", sink_dir)
              .option("checkpointLocation", checkpoint or sink_dir.rstrip("/") + "_checkpoint")
              .outputMode("append"))
    if month_col in enriched.columns:
        writer = writer.partitionBy(month_col)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()
