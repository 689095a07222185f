"""Intermediate tables in the shared folder of the cluster, and connected components over them."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlift.session import scratch_path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives a lost executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def parts_of(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    while name in df.columns:
        name += "_"
    return name


def components(edges: DataFrame) -> DataFrame:
    """(v, label): the smallest vertex reachable over ``edges`` (a, b), for each vertex with an edge.

    Minimum labels spread along the edges and are then replaced by their own label's label, so a path of
    length n needs about log n rounds. Each round is written to the shared folder.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                   .distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m"))
                     .select("v", F.least("v", "m").alias("label")), "labels")
    while True:
        near = (both.join(labels.select(F.col("v").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near")))
        step = labels.join(near, "v").select("v", "label", F.least("label", "near").alias("next"))
        # the label of a label is at most that label, so taking it only shortens paths
        up = labels.select(F.col("v").alias("next"), F.col("label").alias("up"))
        step = written(step.join(up, "next", "left")
                       .select("v", F.col("label").alias("old"), F.least("next", "up").alias("label")), "labels")
        labels = step.select("v", "label")
        if step.where("old <> label").isEmpty():
            return labels


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, for sessions started from a checkout
    (where it is not installed on the workers)."""
    app = spark.sparkContext.applicationId
    if app not in _shipped:
        top = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="run-")) / f"{top.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(top.rglob("*.py")):
                z.write(p, p.relative_to(top.parent))
        spark.sparkContext.addPyFile(str(path))
        _shipped.add(app)
