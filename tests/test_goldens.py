
import math

import pytest
from pyspark.sql import functions as F

from contactlift.functions import rowwise as rw
from contactlift.operators import metrics as M
from contactlift.operators import packs as P
from contactlift.operators import sampling as S

NAN, INF = float("nan"), float("inf")


def _eq(a, b):
    if a is None or b is None:
        return a is None and b is None
    if math.isnan(a) or math.isnan(b):
        return math.isnan(a) and math.isnan(b)
    return a == b


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(1, 3.0, 2.0), (2, 3.0, None), (3, None, None), (4, NAN, 1.0), (5, 4.0, 0.0), (6, -4.0, 0.0),
            (7, 0.0, 0.0), (8, None, 0.0), (9, 1.0, NAN)]
    return spark.createDataFrame(rows, "k int, a double, b double")


def _col(df, expr):
    return {r["k"]: r["v"] for r in df.select("k", expr.alias("v")).collect()}


def test_row_sum_missing_is_zero_and_nan_is_missing(pairs):
    got = _col(pairs, rw.row_sum_narm("a", "b"))
    want = {1: 5.0, 2: 3.0, 3: 0.0, 4: 1.0, 5: 4.0, 6: -4.0, 7: 0.0, 8: 0.0, 9: 1.0}
    assert got == want


def test_row_max_min_mean(pairs):
    assert _col(pairs, rw.row_max_narm("a", "b")) == {1: 3.0, 2: 3.0, 3: None, 4: 1.0, 5: 4.0, 6: 0.0, 7: 0.0,
                                                       8: 0.0, 9: 1.0}
    assert _col(pairs, rw.row_min_narm("a", "b")) == {1: 2.0, 2: 3.0, 3: None, 4: 1.0, 5: 0.0, 6: -4.0, 7: 0.0,
                                                       8: 0.0, 9: 1.0}
    assert _col(pairs, rw.row_mean_narm("a", "b")) == {1: 2.5, 2: 3.0, 3: None, 4: 1.0, 5: 2.0, 6: -2.0, 7: 0.0,
                                                        8: 0.0, 9: 1.0}


def test_row_sum_argument_order(pairs):
    assert _col(pairs, rw.row_sum_narm("a", "b")) == _col(pairs, rw.row_sum_narm("b", "a"))


def test_ieee_ratio(pairs):
    got = _col(pairs, rw.safe_ratio("a", "b"))
    want = {1: 1.5, 2: None, 3: None, 4: NAN, 5: INF, 6: -INF, 7: NAN, 8: None, 9: NAN}
    assert all(_eq(got[k], want[k]) for k in want), got
    nul = _col(pairs, rw.safe_ratio("a", "b", mode="null"))
    assert nul[5] is None and nul[1] == 1.5


def test_pack_sql_and_column_paths_agree(pairs, spark):
    df = pairs.select("k", F.col("a").alias("Master_mlimitecompra"), F.col("b").alias("Visa_mlimitecompra"))
    spec = [("s", "sum", ("Master_mlimitecompra", "Visa_mlimitecompra")),
            ("r", "ratio", ("Master_mlimitecompra", "s")),
            ("m", "mean", ("Master_mlimitecompra", "Visa_mlimitecompra"))]
    a = P.apply_pack(df, spec).orderBy("k").collect()
    b = df.withColumn("s", P.spec_column("sum", spec[0][2])).withColumn("r", P.spec_column("ratio", spec[1][2])) \
        .withColumn("m", P.spec_column("mean", spec[2][2])).orderBy("k").collect()
    for x, y in zip(a, b):
        assert all(_eq(x[c], y[c]) for c in ("s", "r", "m"))


def test_repeated_name_keeps_last_definition():
    assert P.pack_ops("extended")["fe_activos_pasivos_sum"] == "mean"
    assert len(P.pack_columns("extended")) == 81
    assert len(P.pack_columns("std")) == 38 and len(P.pack_columns("combined")) == 49


@pytest.fixture(scope="module")
def scored(spark):
    rows = [(1, 0.025, 1), (2, 0.02499, 1), (3, None, 1), (4, 0.5, 0), (5, 0.5, 1), (6, 0.1, 0)]
    return spark.createDataFrame(rows, "id long, prob double, target int")


def test_profit_inclusive_relative_over_all_rows(scored):
    # contacted: 1 (+19500), 4 (-500), 5 (+19500), 6 (-500) over 6 rows
    assert M.profit_score(scored).first()["profit"] == pytest.approx(38000 / 6)
    assert M.profit_score(scored, relative=False).first()["profit"] == 38000


def test_profit_strict_absolute(scored):
    assert M.profit_absolute(scored, 0.025).first()["profit"] == 18500
    assert M.profit_absolute(scored, 0.9).first()["profit"] == 0


def test_label_si_normalised(spark):
    df = spark.createDataFrame([(1, 0.9, "SI"), (2, 0.9, "NO")], "id long, prob double, clase string")
    t = df.withColumn("target", rw.normalise_target("clase"))
    assert M.profit_score(t).first()["profit"] == pytest.approx((19500 - 500) / 2)


def test_cumulative_gain_order_and_ties(scored):
    got = [(r["id"], r["gain"]) for r in M.cumulative_gain(scored).orderBy("gain").collect()]
    by_id = dict(got)
    # order: 4 (0.5), 5 (0.5), 6, 1, 2, 3 (NULL last)
    assert by_id == {4: -500, 5: 19000, 6: 18500, 1: 38000, 2: 57500, 3: 77000}


def test_breakeven_cutoff():
    assert rw.breakeven_cutoff(undersampling=0.2) == pytest.approx(0.113636, abs=1e-6)
    assert rw.breakeven_cutoff() == pytest.approx(0.025)


def test_auc_ties_and_negation(spark):
    rows = [(1, 0.9, 1), (2, 0.8, 0), (3, 0.8, 1), (4, 0.1, 0)]
    df = spark.createDataFrame(rows, "id long, prob double, target int")
    auc = M.roc_auc(df).first()["auc"]
    assert auc == pytest.approx(0.875)  # pairs: (1>2),(1>4),(3>4) wins, (3=2) half -> 3.5/4
    neg = M.roc_auc(df.withColumn("prob", -F.col("prob"))).first()["auc"]
    assert auc + neg == pytest.approx(1.0)
    curve = sorted((r["x"], r["y"]) for r in M.roc_curve(df).collect())
    assert curve == [(0.0, 0.0), (0.0, 0.5), (0.5, 1.0), (1.0, 1.0)]


def test_sweep_boundaries(spark):
    # prob exactly on sweep cutoffs must count as passing (>=)
    rows = [(1, 0.01, 1), (2, 0.025, 0), (3, 0.05, 1), (4, 0.0099, 1)]
    df = spark.createDataFrame(rows, "id long, prob double, target int")
    out = {round(r["cutoff"], 4): r["profit"] for r in M.cutoff_sweep(df, relative=False).collect()}
    assert len(out) == 201
    assert out[0.01] == 19500 - 500 + 19500
    assert out[0.0252] == 19500
    assert out[0.025] == 19500 - 500
    assert out[0.05] == 19500


@pytest.mark.parametrize("fraction,sizes", [(0.7, {"a": 1, "b": 4, "c": 10, "d": 74, None: 2}),
                                            (0.5, {"a": 0, "b": 2, "c": 8, "d": 52, None: 2})])
def test_stratum_quota_half_even(spark, fraction, sizes):
    rows, i = [], 0
    for s, n in (("a", 1), ("b", 5), ("c", 15), ("d", 105), (None, 3)):
        for _ in range(n):
            rows.append((i, s))
            i += 1
    df = spark.createDataFrame(rows, "id_cliente long, clase string")
    got = {r["clase"]: r["n"] for r in S.stratified_sample(df, fraction, ["clase"], 7).groupBy("clase")
           .agg(F.count("*").alias("n")).collect()}
    want = {k: v for k, v in sizes.items() if v}
    if fraction == 0.5:
        want[None] = 2  # 3 * 0.5 = 1.5 -> 2
    else:
        want[None] = 2  # 3 * 0.7 = 2.1 -> 2
    assert got == want


def test_seed_minus_one_is_master():
    assert S.resolve_seed(-1) == S.MASTER_SEED and S.resolve_seed(5) == 5


def test_day_offsets(spark):
    rows = [(1, 201901, 20190115), (2, 201901, 20190301), (3, 201901, 0), (4, 201901, None),
            (5, 201902, 20190230), (6, 201912, 20191231), (7, 201913, 20190101)]
    df = spark.createDataFrame(rows, "k int, foto_mes int, fecha int")
    got = _col(df, rw.days_to_snapshot_end("foto_mes", "fecha"))
    assert got == {1: 17, 2: -28, 3: None, 4: None, 5: None, 6: 1, 7: None}


def test_frequency_shares(spark):
    rows = [("x", "p", 1), ("x", "p", 2), ("x", "q", 1), ("y", "p", 1)]
    df = spark.createDataFrame(rows, "a string, b string, c int")
    one = {r["a"]: r["freq"] for r in M.group_frequency(df, ["a"]).collect()}
    assert one == {"x": 0.75, "y": 0.25}
    two = {(r["a"], r["b"]): r["freq"] for r in M.group_frequency(df, ["a", "b"]).collect()}
    assert two == {("x", "p"): 2 / 3, ("x", "q"): 1 / 3, ("y", "p"): 1.0}
    three = {(r["a"], r["b"], r["c"]): r["freq"] for r in M.group_frequency(df, ["a", "b", "c"]).collect()}
    assert three == {("x", "p", 1): 0.5, ("x", "p", 2): 0.5, ("x", "q", 1): 1.0, ("y", "p", 1): 1.0}


def test_top5_and_tail(spark):
    rows = [(0, i, float(v)) for i, v in enumerate([5, 1, 9, 7, 3, 8, 2])]
    df = spark.createDataFrame(rows, "seed int, iter int, test_mean double")
    r = M.top5_mean(df).first()
    assert r["top_mean"] == pytest.approx((9 + 8 + 7 + 5 + 3) / 5)
    assert r["iter_mean"] == pytest.approx((2 + 5 + 3 + 0 + 4) / 5)


def test_month_read_prunes_partitions(spark):
    import tempfile

    from contactlift.plans import fixtures as FX
    from contactlift.sources import files as IO
    from paths import SF_SMALL

    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/months"
    snap = FX.snapshot(spark, SF_SMALL)
    IO.snapshot_partitions(snap, path)
    month = snap.select(F.min("foto_mes")).first()[0]
    one = IO.read_month(spark, path, str(month))
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(foto_mes" in plan and f"(foto_mes#" in plan
    assert one.count() == snap.where(F.col("foto_mes") == month).count()


def test_auc_matches_mllib_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    from contactlift.plans import fixtures as FX
    from paths import SF_SMALL

    scored = FX.scored(spark, SF_SMALL)
    ours = M.roc_auc(scored).first()["auc"]
    ev = BinaryClassificationEvaluator(rawPredictionCol="prob", labelCol="label", metricName="areaUnderROC",
                                       numBins=0)
    theirs = ev.evaluate(scored.withColumn("label", F.col("target").cast("double")))
    assert ours == pytest.approx(theirs, abs=1e-12)


def test_ingest_snapshots(spark):
    import tempfile

    from contactlift.plans import fixtures as FX
    from contactlift.sources import files as IO
    from paths import SF_SMALL

    work = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    snap = FX.snapshot(spark, SF_SMALL).withColumnRenamed("fecha", "Master_fechaalta")
    IO.sink_delimited(snap, work + "/src")
    month = snap.select(F.min("foto_mes")).first()[0]
    paths = IO.ingest_snapshots(spark, work + "/src", work + "/out", [month], schema=snap.schema)
    months = IO.scan_columnar(spark, paths["months"])
    assert months.count() == snap.count()
    want = snap.select(rw.days_to_snapshot_end("foto_mes", "Master_fechaalta").alias("d")).agg(F.sum("d")).first()[0]
    assert months.agg(F.sum("Master_fechaalta")).first()[0] == want
    raw = IO.scan_delimited(spark, paths[f"raw_{month}"], snap.schema)
    one = snap.where(F.col("foto_mes") == month)
    assert raw.columns == snap.columns and raw.count() == one.count()
    assert raw.exceptAll(one).isEmpty() and one.exceptAll(raw).isEmpty()
    assert IO.scan_columnar(spark, paths["raw"]).exceptAll(snap).isEmpty()
    whole = IO.scan_delimited(spark, paths["whole"])
    assert whole.columns == snap.columns and whole.count() == snap.count()


def test_exports_are_crlf_with_and_without_header(spark):
    import glob
    import tempfile

    from contactlift.sources import files as IO

    work = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    scores = spark.createDataFrame([(1, 0.5), (2, 0.01), (3, 0.9)], "id_cliente long, prob_positivo double")
    IO.export_ranked_probs(scores, work + "/ranked")
    IO.export_target_ids(scores, work + "/ids", 0.025)
    ranked = b"".join(open(p, "rb").read() for p in sorted(glob.glob(work + "/ranked/part-*")))
    assert ranked.startswith(b"id_cliente\tprob_positivo\r\n")
    assert ranked.split(b"\r\n")[1:4] == [b"3\t0.9", b"1\t0.5", b"2\t0.01"]
    ids = b"".join(open(p, "rb").read() for p in sorted(glob.glob(work + "/ids/part-*")))
    assert ids == b"3\r\n1\r\n"


def test_delimited_read_infers_types(spark):
    import tempfile

    from contactlift.plans import fixtures as FX
    from contactlift.sources import files as IO
    from paths import SF_SMALL

    path = tempfile.mkdtemp(prefix="run-", dir="/tmp") + "/cards"
    cards = FX.cards(spark, SF_SMALL)
    IO.sink_delimited(cards, path)
    back = IO.scan_delimited(spark, path)  # no schema: inferred from the header and values
    assert dict(back.dtypes)["Master_msaldototal"] == "double" and dict(back.dtypes)["clase"] == "string"
    assert back.count() == cards.count()
    assert back.where(F.col("Master_msaldototal").isNull()).count() == cards.where(
        F.col("Master_msaldototal").isNull()).count()


def test_missing_labels_propagate_like_the_original(spark):
    rows = [(1, 0.9, 1), (2, 0.5, None), (3, 0.3, 0), (4, 0.01, 1)]
    df = spark.createDataFrame(rows, "id long, prob double, target int")
    # a contacted missing label: the score is missing
    assert M.profit_score(df, 0.2).first()["profit"] is None
    # not contacted: it does not matter
    assert M.profit_score(df, 0.6).first()["profit"] == pytest.approx(19500 / 4)
    # boosting metric: nothing contacted is 0
    assert M.profit_absolute(df, 0.95).first()["profit"] == 0
    assert M.profit_absolute(df, 0.6).first()["profit"] == 19500
    gains = {r["id"]: r["gain"] for r in M.cumulative_gain(df).collect()}
    assert gains == {1: 19500, 2: None, 3: None, 4: None}


def test_negative_zero_denominator(spark):
    df = spark.createDataFrame([(1, 2.0, -0.0), (2, -2.0, -0.0), (3, 2.0, 0.0), (4, 0.0, -0.0)],
                               "k int, a double, b double")
    got = _col(df, rw.safe_ratio("a", "b"))
    assert got[1] == -INF and got[2] == INF and got[3] == INF and math.isnan(got[4])
    spec = [("r", "ratio", ("a", "b"))]
    packed = {r["k"]: r["r"] for r in P.apply_pack(df, spec).collect()}
    assert packed[1] == -INF and packed[2] == INF and packed[3] == INF and math.isnan(packed[4])


def test_nan_and_infinite_scores(spark):
    rows = [(1, float("nan"), 1), (2, float("inf"), 1), (3, 0.03, 0)]
    df = spark.createDataFrame(rows, "id long, prob double, target int")
    assert M.profit_score(df, relative=False).first()["profit"] == 19500 - 500  # NaN not contacted
    assert M.profit_absolute(df).first()["profit"] == 19500 - 500
    sweep = {r["cutoff_index"]: r["profit"] for r in M.cutoff_sweep(df, relative=False).collect()}
    assert sweep[0] == 19500 - 500 and sweep[200] == 19500


def test_fraction_bounds(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a")], "id_cliente long, clase string")
    with pytest.raises(ValueError):
        S.stratified_sample(df, 1.5, ["clase"])
    with pytest.raises(ValueError):
        S.stratified_sample(df, -0.1, ["clase"])
    assert S.stratified_sample(df, 1.0, ["clase"]).count() == 2
    assert S.stratified_sample(df, 0.0, ["clase"]).count() == 0
    assert S.stratified_sample(df, 1.5, ["clase"], replace=True).count() == 3


def test_nan_scores_rank_last(spark):
    from contactlift.operators import metrics as M
    from contactlift.operators import projections as PR

    df = spark.createDataFrame([(1, float("nan"), 1), (2, 0.4, 0), (3, None, 1), (4, 0.9, 1)], "id int, prob double, target int")
    assert [r["id"] for r in PR.sort_by_prob_desc(df).collect()] == [4, 2, 1, 3]
    got = [(r["prob"], r["n"], r["gain"]) for r in sorted(M.gain_by_prob(df).collect(), key=lambda r: r["contacted"])]
    assert got == [(0.9, 1, 19500), (0.4, 1, 19000), (None, 2, 58000)]
    both = PR.attach_scores_by_id(df, df.where("id > 2"), names=("a", "b"), keep=["target"]).collect()
    assert sorted(tuple(r) for r in both) == [(3, None, 1, None), (4, 0.9, 1, 0.9)]
    long = spark.createDataFrame([(1, 7, 0.5), (1, 8, 0.6), (2, 7, 0.1)], "id int, model_id int, prob double")
    assert sorted(tuple(r) for r in PR.scatter_by_fold(long, [7, 8]).collect()) == [(1, 0.5, 0.6), (2, 0.1, None)]
