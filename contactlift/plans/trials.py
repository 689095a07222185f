"""Experiment jobs: cross-validated profit logs, early stopping, trials over seeds, comparisons.

A booster is a ``boosting.Params`` (the two profiles of the model jobs) or an MLlib ``GBTClassifier``. With ``Params``, folds,
seeds and parameter sets that read the same rows are trained in the same passes over one binned copy of them.

Every experiment is a small driver-side loop over *parameters* (folds, seeds, parameter sets:
driver-size lists), each step launching distributed Spark jobs; no row-level data reaches the
driver. Independent fits run concurrently from a thread pool, as ``CrossValidator(parallelism=)``
does, so a cluster is not idle while one small fit runs.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, replace
from functools import reduce
from hashlib import md5

from pyspark import StorageLevel
from pyspark.errors import AnalysisException
from pyspark.ml.classification import GBTClassifier
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from contactlift.operators import boosting as BO
from contactlift.operators import metrics as M
from contactlift.operators import model as ML
from contactlift.operators import sampling as S
from contactlift.session import reliable_checkpoint, scratch_path

Booster = GBTClassifier | BO.Params


def _union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


# Concurrent fits: small fits are single-task job chains, so several run side by side. Bounded,
# as each fit holds its split statistics (nodes x features x bins) on the driver and executors.
DEFAULT_PARALLELISM = 4
# Seeds of a search whose models share passes; their results are logged when all of them are there.
SEEDS_TOGETHER = 5


def parallel_map(fn, items, parallelism: int | None = None) -> list:
    parallelism = parallelism or DEFAULT_PARALLELISM
    with ThreadPoolExecutor(max_workers=max(1, min(parallelism, len(items)))) as pool:
        return list(pool.map(fn, items))


@dataclass
class Fitted:
    prepared: ML.Prepared
    model: object
    offset: float = 0.0

    def predict(self, df: DataFrame, id_col: str = "id_cliente", keep: Sequence[str] = (), name: str = "prob"):
        return ML.predict_probs(self.model, self.prepared.transform(df), id_col, keep, name, self.offset)


def fit(train: DataFrame, features: Sequence[str], estimator: Booster, label: str = "clase01") -> Fitted | BO.Boosted:
    """The booster, started at the positive rate of the training rows; for MLlib, after the missing-value step fitted on them."""
    if isinstance(estimator, BO.Params):
        return BO.fit(train, features, estimator, label)
    prep = ML.Prepared.fit(train, features)
    # MLlib reads its input several times (split candidates, metadata, binning): persist it once
    data = prep.transform(train, label).select(ML.FEATURES, ML.LABEL).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        weighted, offset = ML.class_balance(data)
        model = estimator.copy().setWeightCol(ML.WEIGHT).fit(weighted)
    finally:
        data.unpersist()
    return Fitted(prep, model, offset)


def cv_profit_logs(folded: DataFrame, features: Sequence[str], sets: Sequence[BO.Params], k: int = 5, label: str = "clase01",
                   cutoff: float = M.CUTOFF, relative: bool = True, fold: str = "fold", patience: int | None = None) -> DataFrame:
    """The profit log of several parameter sets over the folds of one table, all in the same passes: (set, fold, iter, profit).

    With ``patience``, a set stops for itself when its mean over the folds has not risen for so many rounds.
    """
    jobs = [BO.Job(p, j, n) for n, p in enumerate(sets) for j in range(k)]
    _, log = BO.train(folded, features, jobs, label, [fold], cutoff, relative, patience=patience)
    rows = [(m // k, m % k, r, v) for m, r, v in log]  # models x rounds
    return folded.sparkSession.createDataFrame(rows, "set int, fold int, iter int, profit double")


def cv_profit_log(df: DataFrame, features: Sequence[str], estimator: Booster, k: int = 5,
                  seed: int = S.MASTER_SEED, label: str = "clase01", id_col: str = "id_cliente",
                  cutoff: float = M.CUTOFF, parallelism: int | None = None, folded: DataFrame | None = None,
                  relative: bool = True) -> DataFrame:
    """Stratified k-fold CV; profit on the held-out fold after every boosting round: (fold, iter, profit)."""
    own = folded is None
    if own:
        folded = S.stratified_folds(df, k, seed, [label], id_col).persist(StorageLevel.MEMORY_AND_DISK)
    if isinstance(estimator, BO.Params):
        log = cv_profit_logs(folded, features, [estimator], k, label, cutoff, relative).drop("set")
        if own:
            folded.unpersist()
        return log

    def one(j: int) -> DataFrame:
        train = folded.where(F.col("fold") != j)
        valid = folded.where(F.col("fold") == j)
        f = fit(train, features, estimator.copy(), label)
        log = ML.staged_profit(f.model, f.prepared.transform(valid, label), cutoff=cutoff, relative=relative, offset=f.offset)
        return log.withColumn("fold", F.lit(j))

    logs = parallel_map(one, list(range(k)), parallelism or min(k, DEFAULT_PARALLELISM + 1))
    log = _union(logs).select("fold", "iter", "profit")
    if own:
        # the log is small (folds x rounds): checkpoint it, then release the folded training rows
        log = reliable_checkpoint(log)
        folded.unpersist()
    return log


def cv_summary(log: DataFrame) -> DataFrame:
    """Mean and population sd over folds per round."""
    return M.cv_fold_summary(log, by=[], iter_col="iter", fold="fold", value="profit")


def cv_score(log: DataFrame, k: int = 5) -> DataFrame:
    """The reference's CV objective: the mean of the ``k`` best per-round means (one row)."""
    s = cv_summary(log).withColumn("__trial", F.lit(0))
    return M.top5_mean(s, by=["__trial"], k=k).drop("__trial")


def cv_best_score(log: DataFrame) -> DataFrame:
    """Best round and its mean profit (one row); the first round reaching the best wins."""
    s = cv_summary(log)
    return s.orderBy(F.desc("test_mean"), F.asc("iter")).limit(1).select(
        F.col("iter").alias("best_iter"), F.col("test_mean").alias("best_score"), "test_std")


def early_stop_rounds(train: DataFrame, features: Sequence[str], estimator: Booster, k: int = 3,
                      patience: int = 30, seed: int = S.MASTER_SEED, label: str = "clase01",
                      id_col: str = "id_cliente", cutoff: float = M.CUTOFF, relative: bool = False,
                      parallelism: int | None = None, refit_on: DataFrame | None = None) -> tuple[int, Fitted | BO.Boosted]:
    """Best round from a k-fold CV profit log (patience rounds), then a refit on all training rows, or on ``refit_on``.

    ``Params`` train ``patience`` rounds beyond the best one and stop; an MLlib estimator trains all its rounds first.
    """
    if isinstance(estimator, BO.Params):
        whole = train if refit_on is None else refit_on
        (best, model), = early_stop_sets(train, features, [estimator], whole, k, patience, seed, label, id_col, cutoff, relative)
        return best, model
    log = cv_profit_log(train, features, estimator, k, seed, label, id_col, cutoff, parallelism, relative=relative)
    curve = [(r["iter"], r["test_mean"]) for r in cv_summary(log).collect()]  # one row per round
    best = ML.best_round(curve, patience)
    refit = fit(train if refit_on is None else refit_on, features, estimator.copy().setMaxIter(best), label)
    return best, refit


def early_stop_sets(train: DataFrame, features: Sequence[str], sets: Sequence[BO.Params], refit_on: DataFrame, k: int = 3,
                    patience: int = 30, seed: int = S.MASTER_SEED, label: str = "clase01", id_col: str = "id_cliente",
                    cutoff: float = M.CUTOFF, relative: bool = False) -> list[tuple[int, BO.Boosted]]:
    """For each parameter set the best round of its CV on ``train`` and a model of so many rounds on ``refit_on``.

    All sets share the folds' passes, and all refits share theirs.
    """
    return early_stop_tables([(train, refit_on)], features, sets, k, patience, seed, label, id_col, cutoff, relative)[0]


def early_stop_tables(parts: Sequence[tuple[DataFrame, DataFrame]], features: Sequence[str], sets: Sequence[BO.Params], k: int = 3,
                      patience: int = 30, seed: int = S.MASTER_SEED, label: str = "clase01", id_col: str = "id_cliente",
                      cutoff: float = M.CUTOFF, relative: bool = False) -> list[list[tuple[int, BO.Boosted]]]:
    """``early_stop_sets`` for several (CV table, refit table) pairs, whose models all share the same passes."""
    folded = [S.stratified_folds(train, k, seed, [label], id_col).persist(StorageLevel.MEMORY_AND_DISK) for train, _ in parts]
    jobs = [BO.Job(p, j, n) for n, p in enumerate(sets) for j in range(k)]
    logs = BO.train_tables([BO.Table(f, features, jobs, ["fold"]) for f in folded], label, cutoff, relative, patience=patience)
    rows = [(t, m // k, m % k, r, v) for t, (_, log) in enumerate(logs) for m, r, v in log]  # tables x models x rounds
    log = parts[0][0].sparkSession.createDataFrame(rows, "part int, set int, fold int, iter int, profit double")
    curves: dict[tuple[int, int], list[tuple[int, float]]] = {}
    for r in M.cv_fold_summary(log, by=["part", "set"], iter_col="iter", fold="fold", value="profit").collect():  # tables x sets x rounds
        curves.setdefault((r["part"], r["set"]), []).append((r["iter"], r["test_mean"]))
    for f in folded:
        f.unpersist()
    best = [[ML.best_round(curves.get((t, n), []), patience) for n in range(len(sets))] for t in range(len(parts))]
    refits = BO.train_tables([BO.Table(whole, features, [BO.Job(replace(p, rounds=b)) for p, b in zip(sets, rounds)])
                              for (_, whole), rounds in zip(parts, best)], label)
    return [list(zip(rounds, models)) for rounds, (models, _) in zip(best, refits)]


def train_score_workflow(df: DataFrame, features: Sequence[str], estimator: Booster,
                         split: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None,
                         test: DataFrame | None = None, label: str = "clase01", id_col: str = "id_cliente",
                         cutoff: float = M.CUTOFF) -> tuple[Fitted | BO.Boosted, DataFrame, DataFrame]:
    """Optional split -> train -> predict -> profit. Returns (fitted, predictions, profit row)."""
    if split is None and test is None:
        raise ValueError("give a split or a test frame: rows that were trained on are not a test")
    train, hold = split(df) if split else (df, test)
    f = fit(train, features, estimator, label)
    preds = f.predict(hold, id_col, keep=[label])
    profit = M.profit_score(preds.withColumnRenamed(label, "target"), cutoff)
    return f, preds, profit


# --- trials --------------------------------------------------------------------------------------

class TrialLog:
    """Parquet log of finished (trial, seed) evaluations; a rerun skips finished ones.

    Each evaluation writes its own partition folder ``trial_id=<t>/seed=<s>/run=<key>`` (overwrite; the
    key stands for its parameters, folds, rounds and features), so concurrent evaluations never share a job commit and a repeated one replaces itself.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark = spark
        self.path = path or scratch_path(spark, "trials")

    def finished(self) -> DataFrame | None:
        try:
            return self.spark.read.option("basePath", self.path).parquet(self.path)
        except AnalysisException as e:
            if "PATH_NOT_FOUND" in (e.getCondition() or ""):
                return None
            raise

    def pending(self, trials: DataFrame, keys: Sequence[str]) -> DataFrame:
        done = self.finished()
        return trials if done is None else trials.join(done.select(*keys).distinct(), list(keys), "left_anti")

    def record(self, rows: DataFrame, trial_id, seed, key: str = "0") -> None:
        rows.drop("trial_id", "seed", "run").write.mode("overwrite").parquet(
            f"{self.path}/trial_id={trial_id}/seed={seed}/run={key}")


def trial_evaluation(df: DataFrame, features: Sequence[str], trials: DataFrame, make: Callable[[dict], Booster],
                     seeds: Sequence[int], log: TrialLog, k: int = 5, label: str = "clase01",
                     id_col: str = "id_cliente", parallelism: int | None = None) -> DataFrame:
    """For each parameter set and seed: k-fold CV objective (top-5 mean); mean over seeds per trial.

    ``trials`` is a small parameter table with a ``trial_id`` column; finished (trial, seed) pairs
    in ``log`` are skipped, so an interrupted search resumes where it stopped. With ``Params``, the models of ``parallelism``
    seeds (default ``SEEDS_TOGETHER``) share the passes, and are logged together.
    """
    params = [c for c in trials.columns if c != "trial_id"]
    grid = S.cross_seed_rows(trials, seeds)
    wanted = []
    for row in grid.collect():  # trials x seeds: a parameter list
        p = row.asDict()
        est = make({c: p[c] for c in params})
        own = asdict(est).items() if isinstance(est, BO.Params) else [(x.name, v) for x, v in est.extractParamMap().items()]
        what = [sorted((c, repr(p[c])) for c in params), k, sorted(features), label, id_col,
                sorted((str(x), repr(v)) for x, v in own if x != "seed")]
        wanted.append((p["trial_id"], p["seed"], "r" + md5(repr(what).encode()).hexdigest()[:12]))
    keys = df.sparkSession.createDataFrame(
        wanted, StructType([grid.schema["trial_id"], grid.schema["seed"], StructField("run", StringType())]))
    todo = log.pending(grid.join(keys, ["trial_id", "seed"]), ["trial_id", "seed", "run"]).collect()

    def one(row) -> None:
        p = row.asDict()
        est = make({c: p[c] for c in params}).setSeed(int(p["seed"]))
        cv = cv_profit_log(df, features, est, k, int(p["seed"]), label, id_col, parallelism=1)
        y = cv_score(cv).select(F.col("top_mean").alias("y"))
        out = y.select(*[F.lit(p[c]).alias(c) for c in params], "y")
        log.record(out, p["trial_id"], p["seed"], p["run"])

    def together(rows: DataFrame, some: Sequence[int]) -> None:
        """All unfinished trials of some seeds whose estimators are ``Params``, each seed's over its own folds, in the same passes."""
        mine = [[row.asDict() for row in todo if row["seed"] == seed] for seed in some]
        folded = [S.stratified_folds(rows, k, int(seed), [label], id_col).persist(StorageLevel.MEMORY_AND_DISK) for seed in some]
        logs = BO.train_tables([BO.Table(f, features, [BO.Job(replace(make({c: p[c] for c in params}), seed=int(seed)), j, n)
                                                       for n, p in enumerate(each) for j in range(k)], ["fold"])
                                for seed, each, f in zip(some, mine, folded)], label)
        for f in folded:
            f.unpersist()
        long = [(t, m // k, m % k, r, v) for t, (_, each) in enumerate(logs) for m, r, v in each]  # seeds x models x rounds
        cv = reliable_checkpoint(df.sparkSession.createDataFrame(long, "table int, set int, fold int, iter int, profit double"))

        def scored(at: tuple[int, int]) -> None:
            p = mine[at[0]][at[1]]
            y = cv_score(cv.where((F.col("table") == at[0]) & (F.col("set") == at[1]))).select(F.col("top_mean").alias("y"))
            log.record(y.select(*[F.lit(p[c]).alias(c) for c in params], "y"), p["trial_id"], p["seed"], p["run"])

        parallel_map(scored, [(t, n) for t, each in enumerate(mine) for n in range(len(each))])

    if todo and isinstance(make({c: todo[0][c] for c in params}), BO.Params):
        pending = sorted({row["seed"] for row in todo})
        # every seed ranks and folds the rows anew: they are made once
        rows = reliable_checkpoint(df.select(*dict.fromkeys([id_col, label, *features])))
        size = parallelism or SEEDS_TOGETHER
        for at in range(0, len(pending), size):
            together(rows, pending[at:at + size])
    else:
        parallel_map(one, todo, parallelism)
    done = log.finished().join(keys, ["trial_id", "seed", "run"], "left_semi")
    return M.seed_mean(done, ["trial_id", *params], "y")


# --- comparisons ---------------------------------------------------------------------------------

def compare_over_seeds(df: DataFrame, seeds: Sequence[int], variants: dict[str, Callable[[DataFrame, DataFrame, int], DataFrame]],
                       baseline: str, label: str = "clase01", id_col: str = "id_cliente",
                       strata: Sequence[str] = ("clase01",), parallelism: int | None = None) -> DataFrame:
    """For each seed: one split; every variant trains on it and scores the test part.

    ``variants[name](train, test, seed)`` returns predictions (id, prob, label). Result: long
    (seed, variant, profit, pct_of_baseline).
    """
    def one(s: int) -> list[DataFrame]:
        train, test = (x.persist(StorageLevel.MEMORY_AND_DISK) for x in S.train_test_split(df, 0.7, s, list(strata), id_col))
        out = []
        for name, run in variants.items():
            prof = M.profit_score(run(train, test, s).withColumnRenamed(label, "target"))
            out.append(reliable_checkpoint(prof.select(F.lit(s).alias("seed"), F.lit(name).alias("variant"), "profit")))
        train.unpersist()
        test.unpersist()
        return out

    long = reliable_checkpoint(_union([x for xs in parallel_map(one, list(seeds), parallelism) for x in xs]))  # seeds x variants rows
    return _against(long, baseline)


def _against(long: DataFrame, baseline: str) -> DataFrame:
    base = long.where(F.col("variant") == baseline).select("seed", F.col("profit").alias("__base"))
    return long.join(base, "seed").withColumn("pct_of_baseline", F.col("profit") / F.nullif(F.col("__base"), F.lit(0.0)) * 100.0).drop("__base")


@dataclass(frozen=True)
class Variant:
    """What a comparison trains: shares of parameter sets over one feature list (the shares' weighted sum is the score)."""

    features: tuple[str, ...]
    parts: tuple[tuple[BO.Params, float], ...]


def marked_splits(df: DataFrame, seeds: Sequence[int], strata: Sequence[str] = ("clase01",), id_col: str = "id_cliente",
                  fraction: float = 0.7) -> tuple[DataFrame, list[str]]:
    """``df`` with one column per seed that is 1 for the rows of the seed's test part and 0 for the others.

    The test parts are narrow (id, seed) rows that are joined to the wide rows once, for all seeds.
    """
    names = [f"__test{i}" for i in range(len(seeds))]
    tests = _union(parallel_map(lambda i: S.train_test_split(df, fraction, seeds[i], list(strata), id_col)[1].select(id_col, F.lit(i).alias("__at")),
                                list(range(len(seeds)))))
    marks = tests.groupBy(id_col).agg(*[F.max((F.col("__at") == i).cast("int")).alias(n) for i, n in enumerate(names)])
    return df.join(marks, id_col, "left").fillna(0, names), names


def compare_params(df: DataFrame, seeds: Sequence[int], variants: dict[str, Variant], baseline: str, label: str = "clase01",
                   id_col: str = "id_cliente", strata: Sequence[str] = ("clase01",), cutoff: float = M.CUTOFF) -> DataFrame:
    """``compare_over_seeds`` for ``Params``: every model that reads the same features and bins, whatever its seed or
    variant, is trained in the same passes. Long (seed, variant, profit, pct_of_baseline)."""
    marked, names = marked_splits(df, seeds, strata, id_col)
    marked = reliable_checkpoint(marked).persist(StorageLevel.MEMORY_AND_DISK)
    alike: dict[tuple, list[tuple[int, BO.Params]]] = {}
    for v in variants.values():
        for p, _ in v.parts:
            for i, s in enumerate(seeds):
                key, one = (v.features, p.max_bin), (i, replace(p, seed=int(s)))
                if one not in alike.setdefault(key, []):
                    alike[key].append(one)
    trained = {}
    # tables with features and bins of their own share the passes
    runs = BO.train_tables([BO.Table(marked, list(features), [BO.Job(p, 1, n, i) for n, (i, p) in enumerate(each)], names)
                            for (features, _), each in alike.items()], label)
    scored = {}  # of each table, a column of probabilities per model for the rows of its seed's test part
    for (key, each), (models, _) in zip(alike.items(), runs):
        columns = [f"__p{n}" for n in range(len(each))]
        table = BO.predict_together(models, columns, marked, id_col, [label, *names], [names[i] for i, _ in each])
        scored[key] = reliable_checkpoint(table)
        trained.update({(key, i, p): c for (i, p), c in zip(each, columns)})
    rows = []
    for name, v in variants.items():
        for i, s in enumerate(seeds):
            preds = None
            for n, (p, share) in enumerate(v.parts):
                key = v.features, p.max_bin
                one = scored[key].where(F.col(names[i]) == 1).select(
                    id_col, *([label] if n == 0 else []), F.col(trained[key, i, replace(p, seed=int(s))]).alias(f"__s{n}"))
                preds = one if preds is None else preds.join(one, id_col)
            prob = reduce(lambda a, b: a + b, [F.lit(float(share)) * F.col(f"__s{n}") for n, (_, share) in enumerate(v.parts)])
            profit = M.profit_score(preds.select(F.col(label).alias("target"), prob.alias("prob")), cutoff)
            rows.append(profit.select(F.lit(s).alias("seed"), F.lit(name).alias("variant"), "profit"))
    long = reliable_checkpoint(_union(rows))  # seeds x variants rows
    marked.unpersist()
    return _against(long, baseline)


def cutoff_sweep_experiment(df: DataFrame, features: Sequence[str], estimator: Booster, seeds: Sequence[int],
                            label: str = "clase01", id_col: str = "id_cliente",
                            parallelism: int | None = None) -> DataFrame:
    """Per seed: split (with that seed), train, profit at each sweep cutoff on the test part; then the mean."""
    if isinstance(estimator, BO.Params):
        marked, names = marked_splits(df, seeds, [label], id_col)
        marked = reliable_checkpoint(marked)
        models, _ = BO.train(marked, features, [BO.Job(replace(estimator, seed=int(s)), 1, i, i) for i, s in enumerate(seeds)], label, names)
        return M.mean_gain_by_cutoff(_union([
            M.cutoff_sweep(m.predict(marked.where(F.col(n) == 1), id_col, keep=[label]).withColumnRenamed(label, "target"))
            .withColumn("seed", F.lit(s)) for m, n, s in zip(models, names, seeds)]))

    def one(s: int) -> DataFrame:
        train, test = S.train_test_split(df, 0.7, s, [label], id_col)
        f = fit(train, features, estimator.copy().setSeed(s), label)
        preds = f.predict(test, id_col, keep=[label]).withColumnRenamed(label, "target")
        return M.cutoff_sweep(preds).withColumn("seed", F.lit(s))

    sweeps = _union(parallel_map(one, list(seeds), parallelism))
    return M.mean_gain_by_cutoff(sweeps)


def oof_score_table(df: DataFrame, features: Sequence[str], grid: Sequence[dict], make: Callable[[dict], Booster],
                    k: int = 5, seed: int = S.MASTER_SEED, undersampling: float = 0.2, inner_folds: int = 3,
                    patience: int = 30, label: str = "clase01", id_col: str = "id_cliente",
                    parallelism: int | None = None) -> DataFrame:
    """Every parameter set x outer fold: undersample the rest, pick rounds by inner CV, refit on the
    whole rest, predict the fold; long (id, model_id, prob) pivoted to one column per parameter set.

    With ``Params``, all sets and outer folds share the passes of the inner CV, and of the refits."""
    folded = S.uniform_sample_column(S.stratified_folds(df, k, seed, [label], id_col), seed)
    folded = folded.persist(StorageLevel.MEMORY_AND_DISK)
    cutoff = (500 / undersampling) / (19500 + 500 / undersampling)
    jobs = [(p, j) for p in grid for j in range(k)]

    def one(job) -> DataFrame:
        p, j = job
        train = S.undersample_majority(folded, undersampling, fold=j, label=label).drop("fold", "sample")
        _, refit = early_stop_rounds(train, features, make(p), inner_folds, patience, seed, label, id_col,
                                     cutoff=cutoff, relative=False, parallelism=1,
                                     refit_on=S.fold_complement(folded, j).drop("fold", "sample"))
        held = folded.where(F.col("fold") == j)
        return refit.predict(held, id_col).withColumn("model_id", F.lit(int(p["id"])))

    ids = [int(p["id"]) for p in grid]
    if grid and isinstance(make(grid[0]), BO.Params):
        parts = [(S.undersample_majority(folded, undersampling, fold=j, label=label).drop("fold", "sample"),
                  S.fold_complement(folded, j).drop("fold", "sample")) for j in range(k)]
        refits = early_stop_tables(parts, features, [make(p) for p in grid], inner_folds, patience, seed, label, id_col, cutoff, relative=False)
        held = _union([BO.predict_together([m for _, m in each], [str(i) for i in ids], folded.where(F.col("fold") == j), id_col)
                       for j, each in enumerate(refits)])
        wide = held.groupBy(id_col).agg(*[F.max(str(i)).alias(str(i)) for i in ids])
    else:
        long = _union(parallel_map(one, jobs, parallelism))
        wide = long.groupBy(id_col).pivot("model_id", ids).agg(F.max("prob"))
    wide = reliable_checkpoint(wide.withColumnsRenamed({str(i): f"modelito_{i}" for i in ids}))
    folded.unpersist()
    return wide


