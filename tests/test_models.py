"""Model jobs: repeatable, probabilities in [0, 1], staged scores agree with the model."""

import math

import pytest
from pyspark.sql import functions as F

from contactlift.operators import boosting as BO
from contactlift.operators import metrics as M
from contactlift.operators import model as ML
from contactlift.operators import projections as PR
from contactlift.plans import fixtures as FX
from contactlift.plans import models as MQ
from contactlift.plans import trials as T
from paths import SF_SMALL


@pytest.fixture(scope="module")
def cards(spark):
    return PR.label_from_class(FX.cards(spark, SF_SMALL)).cache()


def test_missing_step_fills_and_flags(cards):
    feats = PR.feature_columns(cards)
    prep = ML.Prepared.fit(cards, feats)
    assert set(prep.step.flagged) <= set(feats)
    m = prep.transform(cards)
    assert m.where(F.col("features").isNull()).count() == 0


def test_same_seed_same_probs_and_range(cards):
    feats = PR.feature_columns(cards)
    a = T.fit(cards, feats, ML.profile_a(0.1, 4, 0.6, seed=3)).predict(cards).orderBy("id_cliente").collect()
    b = T.fit(cards, feats, ML.profile_a(0.1, 4, 0.6, seed=3)).predict(cards).orderBy("id_cliente").collect()
    assert [r["prob"] for r in a] == [r["prob"] for r in b]
    assert all(0.0 <= r["prob"] <= 1.0 for r in a)


def test_staged_last_round_equals_model(cards):
    feats = PR.feature_columns(cards)
    f = T.fit(cards, feats, ML.profile_b(0.1, 5, 1.0))
    data = f.prepared.transform(cards)
    staged, rounds = ML.staged_probabilities(f.model, data, keep=["id_cliente"], offset=f.offset)
    last = {r["id_cliente"]: r[f"__p{rounds[-1]}"] for r in staged.collect()}
    full = {r["id_cliente"]: r["prob"] for r in f.predict(cards).collect()}
    assert all(abs(last[k] - full[k]) < 1e-9 for k in full)


def test_scores_start_at_the_positive_rate(cards):
    feats = PR.feature_columns(cards)
    top = cards.approxQuantile("Master_tconsumos", [0.97], 0.0)[0]
    rare = cards.withColumn("clase01", F.coalesce((F.col("Master_tconsumos") > top).cast("int"), F.lit(0)))
    rate = rare.agg(F.avg("clase01")).first()[0]
    f = T.fit(rare, feats, ML.profile_a(0.1, 4, 1.0))
    assert 0.0 < rate < 0.05 and f.offset == pytest.approx(math.log(rate / (1 - rate)))
    got = f.predict(rare, keep=["clase01"]).groupBy("clase01").agg(F.avg("prob")).collect()
    mean = {r["clase01"]: r["avg(prob)"] for r in got}
    assert mean[0] < 0.025 < mean[1]  # the delivery cutoff separates the classes
    log = ML.staged_profit(f.model, f.prepared.transform(rare), offset=f.offset).collect()
    direct = f.predict(rare, keep=["clase01"]).withColumnRenamed("clase01", "target")
    assert {r["iter"]: r["profit"] for r in log}[4] == pytest.approx(M.profit_score(direct).first()["profit"])


def test_one_class_trains_without_an_offset(cards):
    data, offset = ML.class_balance(cards.select(F.lit(1.0).alias("label")))
    assert offset == 0.0 and data.where("weight <> 1").isEmpty()


def test_best_round_patience():
    curve = [(1, 1.0), (2, 3.0), (3, 2.0), (4, 2.5), (5, 9.0)]
    assert ML.best_round(curve, patience=2) == 2
    assert ML.best_round(curve, patience=5) == 5


def test_cv_log_shape(cards):
    feats = PR.feature_columns(cards)
    log = T.cv_profit_log(cards, feats, ML.profile_a(0.1, 3, 1.0), k=3)
    rows = log.collect()
    assert {(r["fold"], r["iter"]) for r in rows} == {(f, i) for f in range(3) for i in (1, 2, 3)}


def test_profit_evaluator_in_cross_validator(cards):
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    from contactlift.operators import sampling as S

    feats = PR.feature_columns(cards)
    prep = ML.Prepared.fit(cards, feats)
    data = prep.transform(S.stratified_folds(cards, 3, 5, ["clase01"]))
    gbt = ML.profile_a(0.1, 3, 1.0)
    grid = ParamGridBuilder().addGrid(gbt.stepSize, [0.05, 0.2]).build()
    ev = ML.ProfitEvaluator()
    cv = CrossValidator(estimator=gbt, estimatorParamMaps=grid, evaluator=ev, foldCol="fold", parallelism=2)
    model = cv.fit(data)
    assert len(model.avgMetrics) == 2
    direct = ev.evaluate(model.bestModel.transform(data))
    from contactlift.operators import metrics as M
    preds = ML.predict_probs(model.bestModel, data, keep=["label"]).withColumnRenamed("label", "target")
    assert direct == pytest.approx(M.profit_score(preds).first()["profit"])


def test_trial_log_resumes(spark, cards):
    import tempfile

    feats = PR.feature_columns(cards)
    trials = spark.createDataFrame([(1, 0.1), (2, 0.3)], "trial_id int, eta double")
    make = lambda p: ML.profile_a(p["eta"], 2, 1.0)
    log = T.TrialLog(spark, tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/log")
    first = T.trial_evaluation(cards, feats, trials, make, [7, 8], log, k=2).collect()
    assert {r["trial_id"] for r in first} == {1, 2} and all(r["n_seeds"] == 2 for r in first)
    assert log.pending(S_cross(trials), ["trial_id", "seed"]).count() == 0
    # fewer seeds are not averaged with the logged ones, and other parameters are trained anew
    fewer = T.trial_evaluation(cards, feats, trials, make, [8], log, k=2).collect()
    assert all(r["n_seeds"] == 1 for r in fewer)
    other = spark.createDataFrame([(1, 0.5)], "trial_id int, eta double")
    again = T.trial_evaluation(cards, feats, other, make, [8], log, k=2).collect()
    assert [(r["trial_id"], r["eta"]) for r in again] == [(1, 0.5)]


def S_cross(trials):
    from contactlift.operators import sampling as S
    return S.cross_seed_rows(trials, [7, 8])


def test_staged_profit_matches_profit_score_per_round(cards):
    from contactlift.operators import metrics as M

    feats = PR.feature_columns(cards)
    f = T.fit(cards, feats, ML.profile_a(0.2, 4, 1.0))
    data = f.prepared.transform(cards)
    log = {r["iter"]: r["profit"] for r in ML.staged_profit(f.model, data, cutoff=0.3).collect()}
    staged, rounds = ML.staged_probabilities(f.model, data, keep=["label"])
    for k in rounds:
        p = staged.select(F.col(f"__p{k}").alias("prob"), F.col("label").cast("int").alias("target"))
        assert log[k] == pytest.approx(M.profit_score(p, 0.3).first()["profit"])
    # a missing label among contacted rows makes the round's score missing
    holed = data.withColumn("label", F.when(F.col("id_cliente") == F.lit(data.first()["id_cliente"]), None)
                            .otherwise(F.col("label")))
    assert all(r["profit"] is None for r in ML.staged_profit(f.model, holed, cutoff=0.0).collect())


def test_log_loss_falls_with_rounds_on_separable_data(cards):
    feats = PR.feature_columns(cards)
    cut = cards.approxQuantile("Master_tconsumos", [0.5], 0.0)[0]
    sep = cards.withColumn("clase01", (F.col("Master_tconsumos") > cut).cast("int"))
    f = T.fit(sep, feats, ML.profile_b(0.3, 8, 1.0))
    losses = f.model.evaluateEachIteration(ML.class_balance(f.prepared.transform(sep))[0])  # the model's logistic loss
    assert all(b <= a + 1e-12 for a, b in zip(losses, losses[1:]))
    assert losses[-1] < losses[0]


def test_vector_features(spark):
    from contactlift.plans import fixtures as FX

    df = FX.vectors(spark, SF_SMALL)
    f = T.fit(df, ["embedding"], ML.profile_a(0.2, 3, 1.0))
    assert len(f.prepared.names) == 64
    preds = f.predict(df).collect()
    assert len(preds) == df.count() and all(0 <= r["prob"] <= 1 for r in preds)


def test_wide_rows_are_made_by_several_tasks(spark, tmp_path, monkeypatch):
    """one small file of keys is dealt to the tasks, with the same rows; a table of few rows stays in its file's task"""
    spark.range(0, 1000, 1, 1).selectExpr("id % 900 as c_custkey", "if(id % 11 = 0, -1.0, 1.0) as c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    assert FX.wide_labelled(spark, str(tmp_path)).rdd.getNumPartitions() == 1
    whole = sorted(map(repr, FX.wide_labelled(spark, str(tmp_path)).collect()))
    monkeypatch.setattr(FX, "SPREAD_ROWS", 250)
    dealt = FX.wide_labelled(spark, str(tmp_path))
    assert dealt.rdd.getNumPartitions() == 4 and sorted(map(repr, dealt.collect())) == whole
    each = dealt.groupBy(F.spark_partition_id()).count().collect()
    assert len(each) == 4 and max(r["count"] for r in each) <= 300


def test_tuned_comparison_bins_and_trains_once(spark, tmp_path, monkeypatch):
    """three models of one split: one set of bins, one run of passes, rows as of models trained alone"""
    spark.range(0, 600, 1, 1).selectExpr("id as c_custkey", "if(id % 11 = 0 or id % 50 = 3, -1.0, 1.0) as c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    est = MQ.est_a
    monkeypatch.setattr(MQ, "est_a", lambda p=MQ.DEFAULT_A, rounds=2, seed=1: est({**p, "eta": 0.3}, min(rounds, 3), seed))
    fitted, trained, fit, boost = [], [], BO.Binning.fit, BO._boost
    monkeypatch.setattr(BO.Binning, "fit", lambda *a: fitted.append(1) or fit(*a))
    monkeypatch.setattr(BO, "_boost", lambda *a: trained.append(1) or boost(*a))
    got = {r["variant"]: r["profit"] for r in MQ.q_tuned(spark, str(tmp_path)).collect()}
    assert len(fitted) == 1 and len(trained) == 1
    df = MQ.wide(spark, str(tmp_path))
    train, test = MQ.split(df)
    (train_fe, fs), (test_fe, _) = MQ._std(train), MQ._std(test)
    default, tuned, raw = MQ.est_a(seed=102191), MQ.est_a(MQ.TUNED_A, 3, 102191), MQ.feats(df)
    for name, a, b, f, p in (("default_raw", train, test, raw, default), ("tuned_raw", train, test, raw, tuned), ("default_std", train_fe, test_fe, fs, default)):
        alone = BO.fit(a, f, p).predict(b, keep=["clase01"]).withColumnRenamed("clase01", "target")
        assert got[name] == pytest.approx(M.profit_score(alone).first()["profit"])
    assert set(got) == {"default_raw", "tuned_raw", "default_std"}


def test_seeds_of_a_search_share_the_passes(spark, cards, tmp_path, monkeypatch):
    """all seeds are trained in one run of passes, each over its own folds; what is logged is what seeds alone give"""
    feats = PR.feature_columns(cards)
    trials = spark.createDataFrame([(1, 0.1), (2, 0.3)], "trial_id int, eta double")
    make = lambda p: BO.profile_a(p["eta"], 2, 1.0)
    log, alone = (T.TrialLog(spark, f"{tmp_path}/{n}") for n in ("log", "alone"))
    runs, boost = [], BO._boost
    monkeypatch.setattr(BO, "_boost", lambda *a: runs.append(1) or boost(*a))
    T.trial_evaluation(cards, feats, trials, make, [7, 8], log, k=2)
    assert len(runs) == 1
    T.trial_evaluation(cards, feats, trials, make, [7, 8], alone, k=2, parallelism=1)
    assert len(runs) == 3
    rows = [sorted((r["trial_id"], r["seed"], round(r["y"], 6)) for r in x.finished().collect()) for x in (log, alone)]
    assert rows[0] == rows[1] and len(rows[0]) == 4


@pytest.mark.parametrize("query, rounds, models, seeds, patience", [
    ("blended_delivery", [400], 2, 1, None), ("cv_best_score", [500], 5, 1, None), ("feature_pack_comparison", [300], 60, 20, None),
    ("model_comparison", [300, 400], 15, 5, None), ("tuned_comparison", [300, 450], 3, 1, None), ("oof_score_table", [1000], 25 * 3 * 5, 1, 30)])
def test_queries_train_the_recorded_rounds(spark, tmp_path, monkeypatch, query, rounds, models, seeds, patience):
    """the whole search, delivery or comparison: every recorded round, seed and limit reaches the trainer"""
    spark.range(0, 80, 1, 1).selectExpr("id as c_custkey", "if(id % 5 = 0, -1.0, 1.0) as c_acctbal").write.parquet(f"{tmp_path}/customer.parquet")
    spark.range(0, 300, 1, 1).selectExpr("id as o_orderkey", "id % 70 as o_custkey", "if(id % 2 = 0, 'F', 'O') as o_orderstatus",
                                         "cast(id * 37 % 101 as double) as o_totalprice").write.parquet(f"{tmp_path}/orders.parquet")
    asked = []

    class Enough(Exception):
        pass

    def boost(packs, models, jobs, at, cutoff, relative, strict, patience):
        asked.append((jobs, patience))
        raise Enough

    monkeypatch.setattr(BO, "_boost", boost)
    with pytest.raises(Enough):
        MQ.MODEL_QUERIES[query](spark, str(tmp_path))
    (jobs, stop), = asked
    assert sorted({j.params.rounds for j in jobs}) == rounds and len(jobs) == models
    assert len({j.params.seed for j in jobs}) == seeds and stop == patience
