"""Entry points named after the original R helpers, for users switching over.

Each takes DataFrames (not vectors) and returns DataFrames; the work is the library's Spark plans.

=========================  ===============================================
original helper            here
=========================  ===============================================
score.prediction           ``score_prediction``  (metrics.profit_score)
get.gain.vs.prob           ``get_gain_vs_prob``  (metrics.cumulative_gain)
get.roc.data               ``get_roc_data``      (metrics.roc_auc / roc_curve)
sample.df                  ``sample_df``         (sampling.stratified_sample)
split.train.test.df        ``split_train_test_df``
summary.group              ``summary_group``     (metrics.group_frequency)
get.seeds                  ``get_seeds``
enrich.fe.*                ``enrich_fe_std`` / ``enrich_fe_small_extended`` / ``enrich_fe_extended``
fdias_entre                ``fdias_entre``       (functions.days_to_snapshot_end)
DfHolder                   ``holder``            (label, mean, feature matrix)
=========================  ===============================================
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlift.functions.rowwise import days_to_snapshot_end, normalise_target
from contactlift.operators import metrics as M
from contactlift.operators import model as ML
from contactlift.operators import packs as P
from contactlift.operators import projections as PR
from contactlift.operators import sampling as S

# ---------------------------------------------------------------------------------------------
# The experiment seed list, in its original order (the master seed first).
# ---------------------------------------------------------------------------------------------
SEED_LIST = (
    S.MASTER_SEED,
    102191, 253751, 466787, 219277, 529229, 664133, 413353, 418637, 568201, 647753,
    326869, 598691, 751997, 592747, 531287, 778049, 289169, 796151, 305971, 977593,
    26449, 26459, 26479, 26489, 26497, 26501, 26513, 26539, 26557, 26561,
    26573, 26591, 26597, 26627, 26633, 26641, 26647, 26669, 26681, 26683,
    26687, 26693, 26699, 26701, 26711, 26713, 26717, 26723, 26729, 26731,
    26737, 26759, 26777, 26783, 26801, 26813, 26821, 26833, 26839, 26849,
    26861, 26863, 26879, 26881, 26891, 26893, 26903, 26921, 26927, 26947,
    33487, 33493, 33503, 33521, 33529, 33533, 33547, 33563, 33569, 33577,
    33581, 33587, 33589, 33599, 33601, 33613, 33617, 33619, 33623, 33629,
    33637, 33641, 33647, 33679, 33703, 33713, 33721, 33739, 33749, 33751,
    33757, 33767, 33769, 33773, 33791, 33797, 33809, 33811, 33827, 33829,
    33851, 33857, 33863, 33871, 33889, 33893, 33911, 33923, 33931, 33937,
)


def get_seeds(spark: SparkSession, n: int = 20) -> DataFrame:
    """The first ``n`` seeds as a one-column table (a parameter list, at most 121 rows)."""
    return spark.createDataFrame([(int(s),) for s in SEED_LIST[:n]], "seed long")


def score_prediction(df: DataFrame, cutoff: float = M.CUTOFF, relative: bool = True, prob: str = "prob",
                     target: str = "target") -> DataFrame:
    """Profit of contacting ``prob >= cutoff``; the target may be 1 or 'SI'."""
    return M.profit_score(df.withColumn(target, normalise_target(target)), cutoff, relative, prob, target)


def get_gain_vs_prob(df: DataFrame, prob: str = "prob", target: str = "target", id_col: str = "id") -> DataFrame:
    """(id, prob, target, gain): the running profit by descending probability."""
    return M.cumulative_gain(df, id_col, prob, target)


def get_roc_data(df: DataFrame, prob: str = "prob", target: str = "target") -> tuple[DataFrame, DataFrame]:
    """(one-row auc table, curve table with x = fpr and y = tpr)."""
    return M.roc_auc(df, prob, target), M.roc_curve(df, prob, target)


def sample_df(df: DataFrame, fraction: float, *strata: str, replace: bool = False, seed: int = S.MASTER_SEED,
              id_col: str = "id_cliente") -> DataFrame:
    return S.stratified_sample(df, fraction, list(strata), seed, id_col, replace=replace)


def split_train_test_df(df: DataFrame, fraction: float = 0.7, seed: int = -1,
                        id_col: str = "id_cliente") -> dict[str, DataFrame]:
    train, test = S.train_test_split(df, fraction, seed, ["clase"], id_col)
    return {"train": train, "test": test}


def summary_group(df: DataFrame, *keys: str) -> DataFrame:
    """(keys..., n, freq) with freq within all keys but the last."""
    return M.group_frequency(df, list(keys))


def enrich_fe_std(df: DataFrame) -> DataFrame:
    return P.enrich_std(df)


def enrich_fe_small_extended(df: DataFrame) -> DataFrame:
    return P.enrich_small_extended(df)


def enrich_fe_extended(df: DataFrame) -> DataFrame:
    return P.enrich_extended(df)


def fdias_entre(month: str | Column, date: str | Column) -> Column:
    return days_to_snapshot_end(month, date)


@dataclass
class Holder:
    """A labelled table: 0/1 label from the class, its mean, the feature matrix, ids and results."""

    df: DataFrame
    id_col: str = "id_cliente"
    label: str = "clase01"

    @property
    def mean(self) -> float:
        return float(M.label_mean(self.df, self.label).first()["label_mean"])

    def features(self) -> list[str]:
        return PR.feature_columns(self.df, self.id_col, self.label)

    def as_matrix(self, prepared: ML.Prepared | None = None) -> DataFrame:
        return ML.feature_matrix(self.df, self.features(), self.id_col, self.label, prepared)

    def as_results(self) -> DataFrame:
        return self.df.select(self.id_col, self.label)

    def as_clients(self) -> DataFrame:
        return self.df.select(self.id_col)


def holder(df: DataFrame, id_col: str = "id_cliente", class_col: str = "clase") -> Holder:
    return Holder(PR.label_from_class(df, class_col), id_col)


__all__ = [n for n in dir() if not n.startswith("_") and n not in ("annotations", "dataclass", "Column", "DataFrame",
                                                                    "SparkSession", "F")]
