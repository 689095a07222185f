"""The flagship report: cumulative gain by descending probability next to the profit at the cutoff."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from contactlift.operators import metrics as M
from contactlift.plans import fixtures as FX


def gain_report(spark: SparkSession, sf_dir: str, cutoff: float = M.CUTOFF) -> DataFrame:
    scored = FX.scored(spark, sf_dir)
    gain = M.cumulative_gain(scored)
    profit = M.profit_score(scored, cutoff, by=["grp"], name="profit_at_cutoff")
    # one row per priority group: attached by key to every scored row of that group
    return gain.join(profit, "grp", "left")
