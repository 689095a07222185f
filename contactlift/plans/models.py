"""Registered model-job queries: the two boosting profiles of ``operators.boosting``.

Comparisons, deliveries and searches train the recorded rounds (a parameter set's ``rounds``); the queries of single
operators train ``ROUNDS``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlift.api import SEED_LIST
from contactlift.operators import boosting as BO
from contactlift.operators import metrics as M
from contactlift.operators import model as ML
from contactlift.operators import packs as P
from contactlift.operators import projections as PR
from contactlift.operators import sampling as S
from contactlift.plans import fixtures as FX
from contactlift.plans import trials as T
from contactlift.session import reliable_checkpoint, scratch_path
from contactlift.sources import files as IO

MODEL_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
# SQL of those that have one: inputs, and invariants that hold for any trained model.
MODEL_ORACLE: dict[str, str] = {}

ROUNDS = 15
# The first recorded seeds; every comparison trains all of them in the same passes.
SEEDS = (19381, 19387, 19391, 19403, 19417)
# Recorded parameter sets with their rounds. Profile A: default run, tuned run, and the set used by
# the blends; profile B: the search's choice, and the set used by the blends.
DEFAULT_A = {"eta": 0.04, "colsample_bytree": 0.6, "rounds": 300}
TUNED_A = {"eta": 0.0245, "colsample_bytree": 0.212, "rounds": 450}
BLEND_A = {"eta": 0.025, "colsample_bytree": 0.29, "rounds": 400}
CHOSEN_B = {"learning_rate": 0.0155, "feature_fraction": 0.33, "max_depth": 7, "rounds": 500}
BLEND_B = {"learning_rate": 0.015, "feature_fraction": 0.33, "max_depth": 7, "rounds": 400}
# The feature packs are compared over twenty seeds, the first of the seed list.
PACK_SEEDS = SEED_LIST[:20]
# Recorded limits of the out-of-fold table's inner searches.
OOF_ROUNDS, OOF_PATIENCE = 1000, 30


# The out-of-fold table's parameter sets, one of its own and a grid of 24, numbered from 100.
OOF_GRID = [{"learning_rate": 0.3, "max_depth": 4, "min_data_in_leaf": 10, "feature_fraction": 1.0}] + [
    {"learning_rate": rate, "max_depth": depth, "min_data_in_leaf": rows, "feature_fraction": fraction}
    for rate in (0.3, 0.03) for depth in (2, 6, 12) for rows in (1, 100) for fraction in (0.5, 1.0)]
OOF_GRID = [{"id": 100 + i, "min_gain_to_split": 1.0, "lambda_l1": 10.0, "lambda_l2": 20.0, **p} for i, p in enumerate(OOF_GRID)]


def oof_params(p: dict) -> BO.Params:
    return BO.profile_b(num_iterations=OOF_ROUNDS, num_leaves=2048, max_bin=255, **{k: v for k, v in p.items() if k != "id"})


def model_query(name: str):
    def deco(fn):
        MODEL_QUERIES[name] = fn
        return fn
    return deco


def cards(spark: SparkSession, sf: str) -> DataFrame:
    return PR.label_from_class(FX.cards(spark, sf))


def wide(spark: SparkSession, sf: str) -> DataFrame:
    return PR.label_from_class(FX.wide_labelled(spark, sf))


def feats(df: DataFrame) -> list[str]:
    return PR.feature_columns(df)


def est_a(params=DEFAULT_A, rounds=None, seed=S.MASTER_SEED):
    """Profile A; ``rounds`` None: the recorded ones."""
    return BO.profile_a(params["eta"], rounds or params["rounds"], params["colsample_bytree"], seed=seed)


def est_b(params=CHOSEN_B, rounds=None, seed=S.MASTER_SEED):
    """Profile B; ``rounds`` None: the recorded ones."""
    return BO.profile_b(params["learning_rate"], rounds or params["rounds"], params["feature_fraction"], params.get("max_depth", 6), seed=seed)


def split(df: DataFrame, seed: int = -1):
    return S.train_test_split(df, 0.7, seed, ["clase01"])


@model_query("feature_matrix")
def q_feature_matrix(spark, sf):
    """(id, label, one column per position of the matrix row), missing values kept for the booster to route."""
    df = cards(spark, sf)
    fs = feats(df)
    m = ML.matrix_rows(df, fs)
    return m.select("id_cliente", "label", *[F.col("features")[i].alias(f"x{i}") for i in range(len(fs))])


MODEL_ORACLE["feature_matrix"] = FX.with_views("""select id_cliente, case when clase = 'SI' then 1 else 0 end as label,
       cast(Master_msaldototal as double) as x0, cast(Master_tconsumos as double) as x1, cast(Master_mlimitecompra as double) as x2,
       cast(Master_mpagominimo as double) as x3, cast(Visa_msaldototal as double) as x4, cast(Visa_tconsumos as double) as x5,
       cast(Visa_mlimitecompra as double) as x6, cast(Visa_mpagominimo as double) as x7
from f_cards""", f_cards=FX.CARDS_SQL)


@model_query("train_profile_a")
def q_train_a(spark, sf):
    df = cards(spark, sf)
    train, test = split(df)
    return T.fit(train, feats(df), est_a(rounds=ROUNDS)).predict(test, keep=["clase01"])


@model_query("train_profile_b")
def q_train_b(spark, sf):
    df = cards(spark, sf)
    train, test = split(df)
    return T.fit(train, feats(df), est_b(rounds=ROUNDS)).predict(test, keep=["clase01"])


@model_query("predict_probs")
def q_predict(spark, sf):
    df = cards(spark, sf)
    return T.fit(df, feats(df), est_a(rounds=ROUNDS)).predict(df, name="prob_positivo")


@model_query("feature_importance")
def q_importance(spark, sf):
    df = cards(spark, sf)
    return T.fit(df, feats(df), est_a(rounds=ROUNDS)).importance_frame(spark)


@model_query("export_importance")
def q_export_importance(spark, sf):
    df = cards(spark, sf)
    path = scratch_path(spark, "importance")
    IO.sink_delimited(T.fit(df, feats(df), est_a(rounds=ROUNDS)).importance_frame(spark), path, line_sep="\r\n")
    return spark.read.option("sep", "\t").option("header", True).option("lineSep", "\r\n").schema(
        "feature string, gain double, cover double, frequency double").csv(path)


@model_query("train_score_workflow")
def q_workflow(spark, sf):
    df = cards(spark, sf)
    _, _, profit = T.train_score_workflow(df, feats(df), est_a(rounds=ROUNDS), split=lambda d: split(d))
    return profit


@model_query("cv_profit_log")
def q_cv_log(spark, sf):
    df = cards(spark, sf)
    return T.cv_profit_log(df, feats(df), est_a(rounds=ROUNDS), k=5)


@model_query("cv_best_score")
def q_cv_best(spark, sf):
    df = cards(spark, sf)
    log = T.cv_profit_log(df, feats(df), est_b(), k=5)
    return T.cv_best_score(log)


@model_query("early_stop_rounds")
def q_early_stop(spark, sf):
    df = cards(spark, sf)
    train, test = split(df)
    best, refit = T.early_stop_rounds(train, feats(df), est_b(rounds=2 * ROUNDS), k=3, patience=5)
    return refit.predict(test, keep=["clase01"]).withColumn("best_round", F.lit(best))


@model_query("baseline_scoring_run")
def q_baseline_run(spark, sf):
    """Train on the labelled part, score the application part; ranked probs, target ids, importance."""
    df = cards(spark, sf)
    train, apply_ = split(df)
    f = T.fit(train, feats(df), est_a(DEFAULT_A, ROUNDS, seed=102191))
    probs = f.predict(apply_.drop("clase01"), name="prob_positivo")
    base = scratch_path(spark, "baseline")
    IO.export_ranked_probs(probs, f"{base}/ranked")
    IO.export_target_ids(probs, f"{base}/ids", 0.025)
    IO.sink_delimited(f.importance_frame(spark), f"{base}/importance", line_sep="\r\n")
    lines = spark.read.option("sep", "\t").option("lineSep", "\r\n")
    ranked = lines.option("header", True).schema("id_cliente bigint, prob_positivo double").csv(f"{base}/ranked")
    targets = lines.option("header", False).schema("id_cliente bigint").csv(f"{base}/ids").withColumn("contacted", F.lit(True))
    used = lines.option("header", True).schema("feature string, gain double").csv(f"{base}/importance").agg(F.count(F.lit(1)).alias("n_features"))
    return (ranked.join(targets, "id_cliente", "left").withColumn("contacted", F.coalesce("contacted", F.lit(False)))
            .withColumn("n_features", F.lit(used.first()["n_features"])))


def _blend(train: DataFrame, test: DataFrame, features, seed: int = S.MASTER_SEED) -> DataFrame:
    """0.7 x profile A + 0.3 x profile B probabilities, joined on id (the blend parameter sets)."""
    # tables with bins of their own share the passes
    (a,), (b,) = (models for models, _ in BO.train_tables([BO.Table(train, features, [BO.Job(p)])
                                                           for p in (est_a(BLEND_A, seed=seed), est_b(BLEND_B, seed=seed))]))
    j = a.predict(test, keep=["clase01"], name="prob_a").join(b.predict(test, name="prob_b"), "id_cliente")
    return j.select("id_cliente", "clase01", (F.lit(0.7) * F.col("prob_a") + F.lit(0.3) * F.col("prob_b")).alias("prob"))


def _std(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """The standard pack added; features = raw + pack columns."""
    return P.apply_pack(df, "std"), feats(df) + P.pack_columns("std")


@model_query("blended_delivery")
def q_blended_delivery(spark, sf):
    """Standard pack on both sets, two models, blend 0.7/0.3, strict cutoff, ids by descending probability."""
    df = wide(spark, sf)
    train, apply_ = split(df)
    (train_fe, fs), (apply_fe, _) = _std(train), _std(apply_)
    blended = _blend(train_fe, apply_fe, fs)
    path = scratch_path(spark, "delivery")
    IO.export_target_ids(blended, path, 0.025, prob="prob", ranked=True)
    return spark.read.option("lineSep", "\r\n").schema("id_cliente bigint").csv(path)


def _blend_variant(features) -> T.Variant:
    return T.Variant(tuple(features), ((est_a(BLEND_A), 0.7), (est_b(BLEND_B), 0.3)))


@model_query("holdout_comparison")
def q_holdout(spark, sf):
    """Per training seed: default profile A on raw features against the blend on the standard
    pack, both scored on the same external labelled set. All seeds are trained in the same passes."""
    df = wide(spark, sf)
    train, hold = split(df)
    (train_fe, fs), (hold_fe, _) = _std(train), _std(hold)
    raw = feats(df)

    def seeds_of(data, features, params):
        return BO.train(data, features, [BO.Job(replace(params, seed=s), group=i) for i, s in enumerate(SEEDS)])[0]

    base, a, b = (seeds_of(train, raw, est_a(DEFAULT_A, ROUNDS)), seeds_of(train_fe, fs, est_a(BLEND_A, ROUNDS)),
                  seeds_of(train_fe, fs, est_b(BLEND_B, ROUNDS)))
    rows = []
    for i, seed in enumerate(SEEDS):
        j = a[i].predict(hold_fe, keep=["clase01"], name="prob_a").join(b[i].predict(hold_fe, name="prob_b"), "id_cliente")
        blend = j.select("clase01", (F.lit(0.7) * F.col("prob_a") + F.lit(0.3) * F.col("prob_b")).alias("prob"))
        for name, p in (("baseline", base[i].predict(hold, keep=["clase01"])), ("blend", blend)):
            rows.append(M.profit_score(p.withColumnRenamed("clase01", "target")).select(
                F.lit(seed).alias("seed"), F.lit(name).alias("model"), "profit"))
    return T._union(rows)


def _enriched(df: DataFrame, packs) -> tuple[DataFrame, list[str]]:
    names = []
    for pk in packs:
        df = P.apply_pack(df, pk)
        names += P.pack_columns(pk)
    return df, names


@model_query("feature_pack_comparison")
def q_pack_comparison(spark, sf):
    """Raw features, + standard pack, + standard then extended packs; default profile A; % of raw."""
    df = wide(spark, sf)
    raw = feats(df)
    full, added = _enriched(df, ["std", "extended"])
    n = len(P.pack_columns("std"))
    lists = {"none": raw, "std": raw + added[:n], "extended": raw + added}
    variants = {name: T.Variant(tuple(fs), ((est_a(DEFAULT_A), 1.0),)) for name, fs in lists.items()}
    return T.compare_params(full, PACK_SEEDS, variants, "none")


@model_query("model_comparison")
def q_model_comparison(spark, sf):
    """Per seed: default profile A on raw features (baseline); profile A, profile B and their
    blend on the standard pack; % of baseline."""
    df = wide(spark, sf)
    raw = feats(df)
    full, fs = _std(df)
    variants = {
        "baseline": T.Variant(tuple(raw), ((est_a(DEFAULT_A), 1.0),)),
        "profile_a": T.Variant(tuple(fs), ((est_a(BLEND_A), 1.0),)),
        "profile_b": T.Variant(tuple(fs), ((est_b(BLEND_B), 1.0),)),
        "blend": _blend_variant(fs),
    }
    return T.compare_params(full, SEEDS, variants, "baseline")


@model_query("tuned_comparison")
def q_tuned(spark, sf):
    """On one split: default against tuned profile A (each with its recorded rounds), and raw
    against standard-pack features with the default parameters; training seed 102191."""
    df = wide(spark, sf)
    train, test = split(df)
    raw = feats(df)
    (train_fe, fs), (test_fe, _) = _std(train), _std(test)
    seed = 102191
    default, tuned = est_a(DEFAULT_A, seed=seed), est_a(TUNED_A, rounds=TUNED_A["rounds"], seed=seed)
    runs = {"default_raw": BO.Job(default, features=raw), "tuned_raw": BO.Job(tuned, features=raw), "default_std": BO.Job(default)}
    # the pack's rows have the raw features too: one set of bins, one run of passes and one scoring pass serve all three
    models, _ = BO.train(train_fe, fs, list(runs.values()))
    preds = reliable_checkpoint(BO.predict_together(models, list(runs), test_fe, keep=["clase01"]).withColumnRenamed("clase01", "target"))
    rows = [M.profit_score(preds, prob=n).select(F.lit(n).alias("variant"), "profit") for n in runs]
    return T._union(rows)


@model_query("cutoff_sweep_experiment")
def q_sweep_experiment(spark, sf):
    df = cards(spark, sf)
    return T.cutoff_sweep_experiment(df, feats(df), est_a(rounds=ROUNDS), SEEDS)


@model_query("oof_score_table")
def q_oof(spark, sf):
    df = cards(spark, sf)
    return T.oof_score_table(df, feats(df), OOF_GRID, oof_params, k=5, inner_folds=3, patience=OOF_PATIENCE)


@model_query("trial_evaluation")
def q_trials(spark, sf):
    df = cards(spark, sf)
    trials = spark.createDataFrame([(1, 0.04, 0.6), (2, 0.0245, 0.212)], "trial_id int, eta double, colsample_bytree double")
    make = lambda p: BO.profile_a(p["eta"], ROUNDS, p["colsample_bytree"])
    log = T.TrialLog(spark)
    return T.trial_evaluation(df, feats(df), trials, make, SEEDS, log, k=5)


@model_query("train_profile_a_vectors")
def q_train_vectors(spark, sf):
    """Profile A on the embedding vectors (target: label 0), scored on the held-out part."""
    df = FX.vectors(spark, sf)
    train, test = S.train_test_split(df, 0.7, -1, ["clase01"])
    return T.fit(train, ["embedding"], est_a(rounds=ROUNDS)).predict(test, keep=["clase01"])
