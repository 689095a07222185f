"""Boosted-tree model jobs on Spark MLlib.

* ``MissingValueStep``: boosters route missing values natively, MLlib trees reject NaN. Each
  feature gets a fill value (median of the training rows), +-Inf is capped to the finite range
  seen in training, and a 0/1 indicator is added for features that had missing or infinite
  values. Fitting is one aggregate over the training rows; only one number per feature reaches
  the driver.
* ``profile_a`` / ``profile_b``: the two parameter profiles of the reference (histogram trees
  with 31 bins; leaf-wise trees with 255 bins, depth 6, 5 rows per leaf) mapped onto
  ``GBTClassifier``. MLlib differences: the feature subset is drawn per node rather than per
  tree, there are no L1/L2 terms or leaf-count cap, and the first tree has weight 1. MLlib starts
  boosting at 0; ``class_balance`` gives both classes half of the weight and returns the log-odds
  of the positive rate as an offset to add to the margin, so scores start at the positive rate.
* ``staged_profit``: MLlib logs only the loss per round, so the profit after every round is
  computed from the trees themselves: margin_k = sum_{i<=k} w_i * tree_i(x),
  prob_k = 1 / (1 + exp(-2 margin_k - offset)); all rounds are scored in one pass and one aggregate.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlift.operators.metrics import COST, CUTOFF, GAIN

FEATURES = "features"
LABEL = "label"
WEIGHT = "weight"


def _dbl(v: float) -> str:
    """A double literal that parses whatever the magnitude (1e+20, -3.5e-07, ...)."""
    return f"cast('{float(v)!r}' as double)"


@dataclass
class MissingValueStep:
    """Fill, cap and flag missing or infinite feature values (fitted on training rows only)."""

    features: list[str]
    fills: dict[str, float] = field(default_factory=dict)
    lows: dict[str, float] = field(default_factory=dict)
    highs: dict[str, float] = field(default_factory=dict)
    flagged: list[str] = field(default_factory=list)

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str], relative_error: float = 0.001) -> MissingValueStep:
        acc = int(1 / relative_error)
        aggs = []
        for i, f in enumerate(features):
            # one SQL expression per aggregate: parsed in the JVM, no per-node Python calls
            x = f"cast(`{f}` as double)"
            finite = f"(case when isnan({x}) or abs({x}) = double('Infinity') then null else {x} end)"
            aggs += [
                F.expr(f"percentile_approx({finite}, 0.5, {acc})").alias(f"m{i}"),
                F.expr(f"min({finite})").alias(f"lo{i}"),
                F.expr(f"max({finite})").alias(f"hi{i}"),
                F.expr(f"count_if({finite} is null)").alias(f"bad{i}"),
            ]
        row = df.agg(*aggs).first()  # one row, four numbers per feature
        step = cls(list(features))
        for i, f in enumerate(features):
            step.fills[f] = float(row[f"m{i}"]) if row[f"m{i}"] is not None else 0.0
            step.lows[f] = float(row[f"lo{i}"]) if row[f"lo{i}"] is not None else 0.0
            step.highs[f] = float(row[f"hi{i}"]) if row[f"hi{i}"] is not None else 0.0
            if row[f"bad{i}"]:
                step.flagged.append(f)
        return step

    def output_columns(self) -> list[str]:
        return list(self.features) + [f"{f}__missing" for f in self.flagged]

    def transform(self, df: DataFrame) -> DataFrame:
        flags, filled = {}, {}
        for f in self.flagged:
            x = f"cast(`{f}` as double)"
            flags[f"{f}__missing"] = F.expr(
                f"case when {x} is null or isnan({x}) or abs({x}) = double('Infinity') then 1.0D else 0.0D end")
        for f in self.features:
            x = f"cast(`{f}` as double)"
            filled[f] = F.expr(
                f"case when {x} is null or isnan({x}) then {_dbl(self.fills[f])} "
                f"when {x} = double('Infinity') then {_dbl(self.highs[f])} "
                f"when {x} = double('-Infinity') then {_dbl(self.lows[f])} else {x} end")
        # indicators read the raw values, so add them before the filled columns replace them
        return df.withColumns(flags).withColumns(filled)


@dataclass
class Prepared:
    """A fitted missing-value step plus the assembler over its output columns.

    Array columns (e.g. embeddings) are taken whole as vectors (``array_to_vector``); the
    missing-value step applies to scalar columns.
    """

    step: MissingValueStep
    assembler: VectorAssembler
    arrays: dict[str, int] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, features: Sequence[str]) -> Prepared:
        types = dict(df.dtypes)
        scalars = [f for f in features if not types[f].startswith("array")]
        arrays = [f for f in features if types[f].startswith("array")]
        sizes = {}
        if arrays:
            row = df.select(*[F.max(F.size(a)).alias(a) for a in arrays]).first()  # one number per array
            sizes = {a: int(row[a] or 0) for a in arrays}
        step = MissingValueStep.fit(df, scalars) if scalars else MissingValueStep([])
        cols = step.output_columns() + [f"{a}__vec" for a in arrays]
        return cls(step, VectorAssembler(inputCols=cols, outputCol=FEATURES, handleInvalid="error"), sizes)

    def transform(self, df: DataFrame, label: str | None = "clase01") -> DataFrame:
        out = self.step.transform(df) if self.step.features else df
        if self.arrays:
            out = out.withColumns({f"{a}__vec": array_to_vector(F.col(a).cast("array<double>")) for a in self.arrays})
        out = self.assembler.transform(out)
        if label and label in df.columns:
            out = out.withColumn(LABEL, F.col(label).cast("double"))
        return out

    @property
    def names(self) -> list[str]:
        return self.step.output_columns() + [f"{a}[{i}]" for a, n in self.arrays.items() for i in range(n)]


def feature_matrix(df: DataFrame, features: Sequence[str], id_col: str = "id_cliente", label: str = "clase01",
                   prepared: Prepared | None = None) -> DataFrame:
    """(id, label, features vector) after the missing-value step."""
    prep = prepared or Prepared.fit(df, features)
    cols = [id_col] + ([LABEL] if label in df.columns else []) + [FEATURES]
    return prep.transform(df, label).select(*cols)


def matrix_rows(df: DataFrame, features: Sequence[str], id_col: str = "id_cliente", label: str = "clase01") -> DataFrame:
    """(id, label, features array of doubles) with missing values (NULL or NaN) as NULL: the matrix a booster that routes
    missing values by itself reads."""
    x = F.array(*[F.expr(f"nullif(cast(`{f}` as double), double('NaN'))") for f in features]).alias(FEATURES)
    return df.select(id_col, *([F.col(label).cast("int").alias(LABEL)] if label in df.columns else []), x)


def profile_a(eta: float = 0.04, nrounds: int = 300, colsample_bytree: float = 0.6, max_depth: int = 6,
              seed: int = 102191) -> GBTClassifier:
    """Histogram trees, 31 bins (the xgboost profile); defaults are its recorded default run."""
    return GBTClassifier(featuresCol=FEATURES, labelCol=LABEL, maxBins=31, maxDepth=max_depth, stepSize=eta,
                         maxIter=nrounds, featureSubsetStrategy=_fraction(colsample_bytree), seed=seed,
                         lossType="logistic", cacheNodeIds=False)


def profile_b(learning_rate: float = 0.0155, num_iterations: int = 300, feature_fraction: float = 0.33,
              max_depth: int = 6, min_data_in_leaf: int = 5, min_gain_to_split: float = 0.0,
              seed: int = 102191) -> GBTClassifier:
    """255 bins, depth 6, at least 5 rows per leaf (the lightgbm profile). ``max_depth`` is honoured."""
    return GBTClassifier(featuresCol=FEATURES, labelCol=LABEL, maxBins=255, maxDepth=max_depth,
                         minInstancesPerNode=min_data_in_leaf, minInfoGain=min_gain_to_split,
                         stepSize=learning_rate, maxIter=num_iterations,
                         featureSubsetStrategy=_fraction(feature_fraction), seed=seed, lossType="logistic",
                         cacheNodeIds=False)


def _fraction(x: float) -> str:
    return "all" if x >= 1.0 else repr(float(x))


def class_balance(data: DataFrame, label: str = LABEL, weight: str = WEIGHT) -> tuple[DataFrame, float]:
    """``data`` with a weight column that gives both classes the same total, and the log-odds of the positive rate.

    Data of one class (or none) get weight 1 and offset 0.
    """
    p = data.agg(F.avg(F.col(label))).first()[0]
    if p is None or not 0.0 < p < 1.0:
        return data.withColumn(weight, F.lit(1.0)), 0.0
    return (data.withColumn(weight, F.when(F.col(label) == 1, F.lit(0.5 / p)).otherwise(F.lit(0.5 / (1.0 - p)))),
            math.log(p / (1.0 - p)))


def predict_probs(model: GBTClassificationModel, df: DataFrame, id_col: str = "id_cliente",
                  keep: Sequence[str] = (), name: str = "prob", offset: float = 0.0) -> DataFrame:
    """(id, prob of the positive class, kept columns); ``offset`` is the log-odds that boosting starts at."""
    margin = vector_to_array(F.col("rawPrediction"))[1]
    prob = F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * margin - F.lit(float(offset))))
    return model.transform(df).select(id_col, *keep, prob.alias(name))


def tree_outputs(model: GBTClassificationModel, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``keep`` columns plus ``__trees``: the array of every tree's output for the row.

    Each tree is MLlib's own model (JVM prediction); the chain of transforms stays flat because
    each adds one independent column.
    """
    scored = df
    for i, t in enumerate(model.trees):
        scored = t.copy().setFeaturesCol(FEATURES).setPredictionCol(f"__t{i}").transform(scored)
    arr = F.array(*[F.col(f"__t{i}") for i in range(len(model.trees))])
    return scored.select(*keep, arr.alias("__trees"))


def staged_probabilities(model: GBTClassificationModel, df: DataFrame, rounds: Sequence[int] | None = None,
                         keep: Sequence[str] = (), offset: float = 0.0) -> tuple[DataFrame, list[int]]:
    """``keep`` plus ``__p{k}`` = probability after ``k`` trees, for each k in ``rounds``.

    Row-level form for inspection and tests; ``staged_profit`` aggregates without it.
    """
    weights = [float(w) for w in model.treeWeights]
    rounds = list(rounds or range(1, len(weights) + 1))
    outs = tree_outputs(model, df, keep)
    cols = []
    for k in rounds:
        terms = F.slice(F.col("__trees"), 1, k)
        wts = F.array(*[F.lit(w) for w in weights[:k]])
        m = F.aggregate(F.arrays_zip(terms.alias("t"), wts.alias("w")), F.lit(0.0),
                        lambda acc, e: acc + e["t"] * e["w"])
        cols.append((F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(-2.0) * m - F.lit(float(offset))))).alias(f"__p{k}"))
    return outs.select(*keep, *cols), rounds


def staged_profit(model: GBTClassificationModel, df: DataFrame, label: str = LABEL, cutoff: float = CUTOFF,
                  relative: bool = True, rounds: Sequence[int] | None = None, by: Sequence[str] = (),
                  strict: bool = False, offset: float = 0.0) -> DataFrame:
    """Profit after every boosting round, long form: (by..., iter, profit).

    The trees' outputs come from MLlib (JVM); per Arrow batch, a vectorised prefix sum over the
    (rows x rounds) matrix gives every round's probability and the batch emits one partial
    profit per round, so Spark aggregates rounds x batches rows, never rows x rounds.
    """
    import numpy as np
    import pandas as pd

    by = list(by)
    weights = np.array([float(w) for w in model.treeWeights])
    k_all = len(weights)
    rounds = np.array(list(rounds or range(1, k_all + 1)), dtype=np.int64)
    outs = tree_outputs(model, df, keep=[*by, label]).withColumn(label, F.col(label).cast("int"))
    schema = ", ".join([f"`{b}` {outs.schema[b].dataType.simpleString()}" for b in by]
                       + ["iter long", "pts long", "n long", "miss long"])

    def per_batch(batches):
        for pdf in batches:
            if pdf.empty:
                continue
            trees = np.stack(pdf["__trees"].to_numpy())
            probs = 1.0 / (1.0 + np.exp(-2.0 * np.cumsum(trees * weights, axis=1) - offset))[:, rounds - 1]
            hit = probs > cutoff if strict else probs >= cutoff
            labels = pdf[label]
            missing = labels.isna().to_numpy()
            pts = np.where(missing, 0, np.where(labels.fillna(0).to_numpy() == 1, GAIN, -COST)).astype(np.int64)
            keys = pdf[by].drop_duplicates() if by else pd.DataFrame(index=[0])
            for _, key in keys.iterrows():
                mask = np.ones(len(pdf), bool)
                for b in by:
                    mask &= ((pdf[b] == key[b]) | (pdf[b].isna() & pd.isna(key[b]))).to_numpy(dtype=bool)
                sums = pts[mask] @ hit[mask]
                miss = missing[mask].astype(np.int64) @ hit[mask]
                out = pd.DataFrame({"iter": rounds, "pts": sums.astype(np.int64), "n": int(mask.sum()),
                                    "miss": miss.astype(np.int64)})
                for b in by:
                    out.insert(0, b, key[b])
                yield out

    partial = outs.mapInPandas(per_batch, schema)
    agg = partial.groupBy(*by, "iter").agg(F.sum("pts").alias("pts"), F.sum("n").alias("n"),
                                           F.sum("miss").alias("miss"))
    val = F.col("pts") / F.col("n") if relative else F.col("pts").cast("double")
    # a contacted row with a missing label makes that round's score missing
    return agg.select(*by, F.col("iter").cast("int").alias("iter"), F.when(F.col("miss") == 0, val).alias("profit"))


def feature_importance(model: GBTClassificationModel, names: Sequence[str]) -> list[tuple[str, float]]:
    """(feature, importance) pairs, largest first (a driver-size list: one entry per feature)."""
    imp = model.featureImportances.toArray()
    return sorted(zip(names, [float(v) for v in imp]), key=lambda p: (-p[1], p[0]))


def importance_frame(spark, model: GBTClassificationModel, names: Sequence[str]) -> DataFrame:
    return spark.createDataFrame(feature_importance(model, names), "feature string, importance double")


def best_round(curve: Sequence[tuple[int, float]], patience: int = 30) -> int:
    """First round reaching the best mean profit, stopping after ``patience`` rounds without gain."""
    best_k, best_v, since = None, None, 0
    for k, v in sorted(curve):
        if best_v is None or v > best_v:
            best_k, best_v, since = k, v, 0
        else:
            since += 1
            if since >= patience:
                break
    return int(best_k or 1)


class ProfitEvaluator(Evaluator):
    """The profit metric as an MLlib ``Evaluator``: usable by ``CrossValidator`` / ``TrainValidationSplit``.

    Scores ``probability[1] >= cutoff`` (inclusive, relative to all rows) like ``profit_score``;
    with ``strict=True, relative=False`` it is the boosting metric (``>``, absolute).
    """

    def __init__(self, cutoff: float = CUTOFF, label_col: str = LABEL, probability_col: str = "probability",
                 relative: bool = True, strict: bool = False):
        super().__init__()
        self.cutoff, self.label_col, self.probability_col = cutoff, label_col, probability_col
        self.relative, self.strict = relative, strict

    def _evaluate(self, dataset: DataFrame) -> float:
        p = vector_to_array(F.col(self.probability_col))[1]
        hit = p > F.lit(self.cutoff) if self.strict else p >= F.lit(self.cutoff)
        pts = F.when(F.col(self.label_col) == 1, F.lit(GAIN)).otherwise(F.lit(-COST)).cast("bigint")
        s = F.coalesce(F.sum(F.when(hit, pts)), F.lit(0).cast("bigint"))
        val = s / F.count(F.lit(1)) if self.relative else s.cast("double")
        return float(dataset.agg(val.alias("v")).first()["v"])

    def isLargerBetter(self) -> bool:
        return True
