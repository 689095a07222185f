"""Money metrics over scored rows, all as DataFrame aggregates.

Points: a contacted positive earns ``gain`` (19500), a contacted negative costs ``cost`` (500).
Sums of points are kept as BIGINT so they are exact in every engine.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactlift.functions.rowwise import present
from contactlift.operators.ranking import running_sums

# Points per contact and the default probability cutoff.
GAIN = 19500
COST = 500
CUTOFF = 0.025
# The cutoff sweep seq(0.01, 0.05, 0.0002), i.e. (100 + 2 i) / 10000 for i = 0..200.
SWEEP_FIRST, SWEEP_STEP, SWEEP_COUNT, SWEEP_SCALE = 100, 2, 201, 10000


def points(target: Column | str, gain: int = GAIN, cost: int = COST) -> Column:
    """+gain for a positive, -cost otherwise; NULL for a missing label."""
    t = F.col(target) if isinstance(target, str) else target
    return F.when(t.isNull(), F.lit(None)).when(t == 1, F.lit(gain)).otherwise(F.lit(-cost)).cast("bigint")


def profit_score(df: DataFrame, cutoff: float = CUTOFF, relative: bool = True, prob: str = "prob",
                 target: str = "target", by: Sequence[str] = (), name: str = "profit",
                 gain: int = GAIN, cost: int = COST) -> DataFrame:
    """Profit of contacting every row with ``prob >= cutoff``.

    ``relative=True`` divides by all rows of the group (not only the contacted ones); nothing
    contacted gives 0. ``target`` is 0/1 (normalise 'SI' first).
    """
    hit = F.nanvl(F.col(prob).cast("double"), F.lit(None).cast("double")) >= F.lit(cutoff)  # NaN: missing
    pts = F.coalesce(F.sum(F.when(hit, points(target, gain, cost))), F.lit(0).cast("bigint"))
    val = (pts / F.count(F.lit(1))) if relative else pts
    # a contacted row with a missing label makes the score missing (NA propagates through the sum)
    missing = F.count(F.when(hit & F.col(target).isNull(), 1)) > 0
    return df.groupBy(*by).agg(F.when(~missing, val).alias(name))


def profit_absolute(df: DataFrame, cutoff: float = CUTOFF, prob: str = "prob", target: str = "target",
                    by: Sequence[str] = (), name: str = "profit", gain: int = GAIN, cost: int = COST) -> DataFrame:
    """Absolute profit with the strict ``prob > cutoff`` rule of the boosting metric; empty is 0.

    A missing probability is not contacted. (The metric only ever scores model predictions and
    training labels, which are never missing.)
    """
    hit = F.nanvl(F.col(prob).cast("double"), F.lit(None).cast("double")) > F.lit(cutoff)  # NaN: missing
    pts = F.sum(F.when(hit, points(target, gain, cost)))
    return df.groupBy(*by).agg(F.coalesce(pts, F.lit(0).cast("bigint")).alias(name))


def label_mean(df: DataFrame, label: str = "clase01", by: Sequence[str] = ()) -> DataFrame:
    """Positive rate (the booster's base score)."""
    return df.groupBy(*by).agg(F.avg(F.col(label).cast("double")).alias("label_mean"))


def cumulative_gain(df: DataFrame, id_col: str = "id", prob: str = "prob", target: str = "target",
                    by: Sequence[str] = (), num_buckets: int | None = None) -> DataFrame:
    """Running profit when contacting rows by descending probability (missing last, ties by id).

    From the first row with a missing label on, the running profit is missing (as a cumulative
    sum over a missing value is).
    """
    order = [F.desc_nulls_last(present(prob)), F.asc(id_col)]
    missing = F.when(F.col(target).isNull(), 1).otherwise(0).cast("bigint")
    out = running_sums(df, order, {"gain": points(target), "__missing": missing}, partition_by=by,
                       num_buckets=num_buckets)
    return out.withColumn("gain", F.when(F.col("__missing") == 0, F.col("gain"))).drop("__missing")


def gain_by_prob(df: DataFrame, prob: str = "prob", target: str = "target", num_buckets: int | None = None) -> DataFrame:
    """Tie-grouped gain curve: one row per distinct probability, gain after all its rows (missing or NaN: one last row)."""
    per = df.groupBy(present(prob).alias(prob)).agg(F.count(F.lit(1)).alias("n"), F.sum(points(target)).alias("points"))
    return running_sums(per, [F.desc_nulls_last(prob)], {"gain": F.col("points"), "contacted": F.col("n")},
                        num_buckets=num_buckets).drop("points")


def _score_counts(df: DataFrame, prob: str, target: str, num_buckets: int | None) -> DataFrame:
    per = (df.where(present(prob).isNotNull())
           .groupBy(prob)
           .agg(F.sum(F.col(target).cast("bigint")).alias("pos"),
                F.sum((1 - F.col(target)).cast("bigint")).alias("neg")))
    return running_sums(per, [F.desc(prob)], {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")},
                        num_buckets=num_buckets)


def roc_auc(df: DataFrame, prob: str = "prob", target: str = "target", num_buckets: int | None = None) -> DataFrame:
    """Area under the ROC curve, ties handled at distinct scores (trapezoids). One row: auc (NULL when a class is missing), n_pos, n_neg."""
    c = _score_counts(df, prob, target, num_buckets)
    agg = c.agg(
        F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / F.lit(2.0))).alias("area"),
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
    )
    return agg.select(
        (F.col("area") / F.nullif((F.col("n_pos") * F.col("n_neg")).cast("double"), F.lit(0.0))).alias("auc"),
        F.col("n_pos").cast("bigint").alias("n_pos"),
        F.col("n_neg").cast("bigint").alias("n_neg"),
    )


def roc_curve(df: DataFrame, prob: str = "prob", target: str = "target", num_buckets: int | None = None) -> DataFrame:
    """(cutoff, x = fpr, y = tpr) at every distinct score, plus the (0, 0) start with a NULL cutoff."""
    c = _score_counts(df, prob, target, num_buckets)
    n_pos, n_neg = c.agg(F.sum("pos"), F.sum("neg")).first()  # two numbers reach the driver
    pts = c.select(
        F.col(prob).alias("cutoff"),
        (F.col("cum_neg") / F.nullif(F.lit(n_neg).cast("bigint"), F.lit(0).cast("bigint"))).alias("x"),
        (F.col("cum_pos") / F.nullif(F.lit(n_pos).cast("bigint"), F.lit(0).cast("bigint"))).alias("y"),
    )
    origin = df.sparkSession.createDataFrame([(None, 0.0, 0.0)], "cutoff double, x double, y double")
    return pts.unionByName(origin)


def sweep_cutoff(i: int) -> float:
    return (SWEEP_FIRST + SWEEP_STEP * i) / SWEEP_SCALE


def _cutoffs_passed(prob: Column) -> Column:
    """Number of sweep cutoffs c_i with c_i <= prob (0..201), exact at the boundaries."""
    def cut(i: Column) -> Column:
        return (F.lit(SWEEP_FIRST) + F.lit(SWEEP_STEP) * i) / F.lit(SWEEP_SCALE)
    # NaN is missing (never contacted); clipping keeps ceil() far from any overflow under ANSI
    prob = F.nanvl(prob.cast("double"), F.lit(None).cast("double"))
    clipped = F.least(F.greatest(prob, F.lit(-1.0)), F.lit(2.0))
    est = F.ceil((clipped * SWEEP_SCALE - SWEEP_FIRST) / SWEEP_STEP)
    est = F.least(F.greatest(est, F.lit(0)), F.lit(SWEEP_COUNT))
    # the estimate can be off by one through rounding; compare with the exact cutoff values
    fixed = (F.when((est > 0) & (cut(est - 1) > prob), est - 1)
             .when((est < SWEEP_COUNT) & (cut(est) <= prob), est + 1)
             .otherwise(est))
    return F.when(prob.isNull(), F.lit(0)).otherwise(fixed).cast("int")


def cutoff_sweep(df: DataFrame, prob: str = "prob", target: str = "target", by: Sequence[str] = (),
                 relative: bool = True) -> DataFrame:
    """Profit at each of the 201 sweep cutoffs (``prob >= cutoff``), without a rows x cutoffs join.

    Each row is binned by the number of cutoffs it passes (one pass, map-side partial sums).
    A group then has at most 202 bins (a bound set by the sweep, not by the data); they are
    gathered into one array per group and the profit at cutoff i is the sum of bins k > i.
    """
    by = list(by)
    binned = df.select(*by, _cutoffs_passed(F.col(prob)).alias("k"), points(target).alias("pts"))
    per_bin = binned.groupBy(*by, "k").agg(F.sum("pts").alias("pts"), F.count(F.lit(1)).alias("n"))
    per_group = per_bin.groupBy(*by).agg(
        F.map_from_entries(F.collect_list(F.struct("k", "pts"))).alias("bins"),
        F.sum("n").alias("rows"),
    )
    zero = F.lit(0).cast("bigint")

    def after(i):
        return F.aggregate(F.sequence(i + 1, F.lit(SWEEP_COUNT)), zero,
                           lambda acc, k: acc + F.coalesce(F.element_at(F.col("bins"), k), zero))

    profits = F.transform(F.sequence(F.lit(0), F.lit(SWEEP_COUNT - 1)), after)
    out = per_group.select(*by, "rows", F.posexplode(profits).alias("k", "pts"))
    val = F.col("pts") / F.col("rows") if relative else F.col("pts")
    return out.select(*by, F.col("k").alias("cutoff_index"),
                      ((F.lit(SWEEP_FIRST) + F.lit(SWEEP_STEP) * F.col("k")) / F.lit(SWEEP_SCALE)).alias("cutoff"),
                      val.alias("profit"))


def group_frequency(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count per group and its share within the groups that share all keys but the last.

    With one key the share is over the whole table.
    """
    keys = list(keys)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return share_within_parent(counts, keys[:-1], name="freq")


def share_within_parent(counts: DataFrame, keys: Sequence[str], n: str = "n", name: str = "share") -> DataFrame:
    """``n / sum(n)`` within the groups of ``keys`` (the parent level), via an aggregate join.

    A join to the parent totals instead of a window, so a parent with many children is not
    pulled into one task (AQE splits a skewed join partition).
    """
    keys = list(keys)
    if not keys:
        total = counts.agg(F.sum(n)).first()[0] or 0  # one number reaches the driver
        return counts.withColumn(name, F.col(n) / F.lit(total).cast("bigint"))
    totals = counts.groupBy(*keys).agg(F.sum(n).alias("__parent_n")).withColumnsRenamed({k: f"__p_{k}" for k in keys})
    j = counts.join(totals, [counts[k].eqNullSafe(F.col(f"__p_{k}")) for k in keys])
    return j.withColumn(name, F.col(n) / F.col("__parent_n")).drop("__parent_n", *[f"__p_{k}" for k in keys])


# --- CV logs -------------------------------------------------------------------------------------

def cv_fold_summary(log: DataFrame, by: Sequence[str] = ("seed",), iter_col: str = "iter", fold: str = "fold",
                    value: str = "profit") -> DataFrame:
    """Mean and population sd over folds per (by, iter); several rows per fold are averaged first."""
    cells = log.groupBy(*by, iter_col, fold).agg(F.avg(value).alias("__cell"))
    return cells.groupBy(*by, iter_col).agg(
        F.avg("__cell").alias("test_mean"),
        F.stddev_pop("__cell").alias("test_std"),
    )


def mean_by_iteration(summary: DataFrame, iter_col: str = "iter") -> DataFrame:
    """Mean profit and mean of the sd per iteration over seeds."""
    return summary.groupBy(iter_col).agg(F.avg("test_mean").alias("mean_profit"), F.avg("test_std").alias("mean_std"))


def top5_mean(summary: DataFrame, by: Sequence[str] = ("seed",), iter_col: str = "iter", value: str = "test_mean",
              k: int = 5) -> DataFrame:
    """Mean of the ``k`` best per-iteration values per trial, with mean and sd of those iterations.

    Ties go to the later round (an ascending stable sort by value, then the last ``k``). The
    per-trial group has one row per boosting round (bounded by the round count).
    """
    w = Window.partitionBy(*by).orderBy(F.desc(value), F.desc(iter_col))
    best = summary.withColumn("__r", F.row_number().over(w)).where(F.col("__r") <= k)
    return best.groupBy(*by).agg(
        F.avg(value).alias("top_mean"),
        F.avg(F.col(iter_col).cast("double")).alias("iter_mean"),
        F.stddev_samp(F.col(iter_col).cast("double")).alias("iter_sd"),
    )


def seed_mean(results: DataFrame, params: Sequence[str], value: str = "y") -> DataFrame:
    """Objective averaged over seeds per parameter set."""
    return results.groupBy(*params).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("n_seeds"))


def mean_gain_by_cutoff(sweeps: DataFrame, cutoff: str = "cutoff", value: str = "profit") -> DataFrame:
    """Average over seeds of the profit at each cutoff."""
    return sweeps.groupBy(cutoff).agg(F.avg(value).alias("avg_gain"))
