"""Boosting against loops over rows: splits, gains, leaf values, best-first growth, folds in one pass, stopping, importance."""

import heapq
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from contactlift.operators import boosting as B

FEATURES = ["a", "b", "c"]


def rows(n, seed):
    r = random.Random(seed)
    out = []
    for i in range(n):
        a, b, c = r.choice([None, *range(6)]), round(r.gauss(0, 1), 2), r.choice([0.0, 1.0, float("nan"), float("inf"), -3.5])
        y = int((a or 0) + b + (2 if c != c else 0) + r.gauss(0, 1) > 2.5)
        out.append((i, a, b, c, y if i % 29 else None, i % 3, (i // 7) % 2))
    return out


SCHEMA = "id_cliente long, a int, b double, c double, clase01 int, fold int, other int"


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(400, 1), SCHEMA).repartition(3).cache()


def gain_of(parts, p):
    def score(g, h):
        g = math.copysign(max(abs(g) - p.l1, 0.0), g)
        return g * g / (h + p.l2) if h + p.l2 > 0 else 0.0

    (gl, hl), (gr, hr) = parts
    return score(gl, hl) + score(gr, hr) - score(gl + gr, hl + hr)


def best_of(at, bins, g, h, subset, width, p):
    """the best split of some rows by trying every feature, cut and side of missing values, in the order of ties"""
    best = None
    for f in subset:
        for cut in range(1, width):
            for missing_left in (False, True):
                left = [i for i in at if (bins[f][i] == 0 and missing_left) or 0 < bins[f][i] <= cut]
                right = [i for i in at if i not in set(left)]
                hs = [sum(h[i] for i in part) for part in (left, right)]
                if min(len(left), len(right)) < max(1, p.min_rows) or min(hs) < p.min_hessian:
                    continue
                gain = round(gain_of([(sum(g[i] for i in part), x) for part, x in zip((left, right), hs)], p), 9)
                if gain > max(p.min_gain, 1e-9) and (best is None or gain > best[0]):
                    best = (gain, f, cut, missing_left, left, right)
    return best


def queue_tree(bins, y, own, margin, p, subset, width):
    """[(rows, value)] of the leaves of a tree grown by a queue of leaves, the greatest gain first; and the sum of gains"""
    prob = 1 / (1 + np.exp(-margin))
    g, h = prob - y, prob * (1 - prob)
    leaves, queue, gains, n = {}, [], 0.0, 0

    def add(at, depth):
        nonlocal n
        leaves[n] = at
        best = best_of(at, bins, g, h, subset, width, p) if depth < p.max_depth else None
        if best:
            heapq.heappush(queue, (-best[0], n, depth, best))
        n += 1

    add([i for i in range(len(y)) if own[i]], 0)
    while queue and len(leaves) < (p.max_leaves or 10**9):
        gain, node, depth, best = heapq.heappop(queue)
        gains -= gain
        del leaves[node]
        add(best[4], depth + 1)
        add(best[5], depth + 1)

    def value(at):
        sg, sh = sum(g[i] for i in at), sum(h[i] for i in at)
        return -p.eta * math.copysign(max(abs(sg) - p.l1, 0.0), sg) / (sh + p.l2) if sh + p.l2 > 0 else 0.0

    return {frozenset(at): value(at) for at in leaves.values()}, gains


def binned(binning, data):
    out = np.zeros((len(binning.cuts), len(data)), int)
    for j, cuts in enumerate(binning.cuts):
        for i, r in enumerate(data):
            x = r[1 + j]
            out[j][i] = 0 if x is None or x != x else 1 + sum(c < x for c in cuts)
    return out


def routes(tree, bins):
    """leaf of each row by following the nodes one by one"""
    out = []
    for i in range(bins.shape[1]):
        node = 0
        while tree.feature[node] >= 0:
            b = bins[tree.feature[node]][i]
            node = tree.left[node] if (b == 0 and tree.missing_left[node]) or 0 < b <= tree.cut[node] else tree.right[node]
        out.append(node)
    return out


@pytest.mark.parametrize("p", [
    B.Params(rounds=2, eta=0.3, max_depth=3, max_bin=6, l2=1.0, min_hessian=0.5),
    B.Params(rounds=2, eta=0.5, max_depth=4, max_bin=5, l1=0.7, l2=0.3, min_rows=7, min_hessian=0.0, min_gain=0.2),
    B.Params(rounds=2, eta=0.5, max_depth=6, max_leaves=7, max_bin=6, l2=0.0, min_rows=3, min_hessian=1e-3),
    B.Params(rounds=2, eta=0.5, max_depth=5, max_leaves=4, max_bin=4, colsample=0.67, l2=2.0, min_rows=1, min_hessian=0.1),
])
def test_trees_equal_a_queue_over_rows(table, p):
    data = sorted(tuple(r) for r in table.collect())
    m = B.fit(table, FEATURES, p)
    bins = binned(m.binning, data)
    own = [r[4] is not None for r in data]
    y = np.array([r[4] or 0 for r in data], float)
    rate = sum(r[4] for r in data if r[4] is not None) / sum(own)
    assert m.base == pytest.approx(math.log(rate / (1 - rate)))
    margin = np.full(len(data), m.base)
    for k, tree in enumerate(m.trees):
        subset = sorted(np.random.default_rng([p.seed, k]).choice(3, max(1, round(p.colsample * 3)), replace=False).tolist())
        want, gains = queue_tree(bins, y, own, margin, p, subset, p.max_bin + 1)
        node = routes(tree, bins)
        got = {}
        for i, at in enumerate(node):
            if own[i]:
                got.setdefault(at, []).append(i)
        assert {frozenset(v): pytest.approx(tree.value[a]) for a, v in got.items()} == want
        if p.max_leaves:
            assert len(want) <= p.max_leaves
        assert sum(tree.gain) == pytest.approx(gains, abs=1e-6)
        assert (B.walk(tree.arrays(), bins.astype(np.uint8)) == node).all()
        margin += np.array([tree.value[a] for a in node])
    got = {r["id_cliente"]: r["prob"] for r in m.predict(table).collect()}
    assert [got[r[0]] for r in data] == pytest.approx((1 / (1 + np.exp(-margin))).tolist())


def test_leaf_cap_binds(table):
    p = B.Params(rounds=1, max_depth=8, max_leaves=9, l2=0.0, min_hessian=0.0)
    assert len([n for n in B.fit(table, FEATURES, p).trees[0].nodes()]) == 2 * 9 - 1


def test_models_of_one_pass_equal_models_trained_alone(table):
    p, q = B.Params(rounds=7, eta=0.3, max_depth=3), B.Params(rounds=4, eta=0.1, max_depth=2, colsample=0.5, seed=9)
    binning = B.Binning.fit(table, FEATURES, 31)
    jobs = [*[B.Job(p, j, 0) for j in range(3)], *[B.Job(q, j, 1, 1) for j in range(2)], B.Job(q)]
    models, log = B.train(table, FEATURES, jobs, folds=["fold", "other"], binning=binning, cutoff=0.3)
    assert [len(m.trees) for m in models] == [7, 7, 7, 4, 4, 4]
    assert sorted((m, k) for m, k, _ in log) == sorted([(m, k) for m in range(3) for k in range(1, 8)] + [(m, k) for m in (3, 4) for k in range(1, 5)])
    for n, (job, column) in enumerate(zip(jobs, ["fold"] * 3 + ["other"] * 2 + [None])):
        own = table if job.held is None else table.where(F.col(column) != job.held)
        alone = B.train(own, FEATURES, [B.Job(job.params)], binning=binning)[0][0]
        a = sorted((r["id_cliente"], round(r["prob"], 9)) for r in models[n].predict(table).collect())
        assert a == sorted((r["id_cliente"], round(r["prob"], 9)) for r in alone.predict(table).collect())
        if job.held is not None:
            held = table.where((F.col(column) == job.held) & F.col("clase01").isNotNull())
            for k in (1, job.params.rounds):
                scored = models[n].predict(held, keep=["clase01"], rounds=k).collect()
                total = table.where(F.col(column) == job.held).count()
                want = sum((19500 if r["clase01"] == 1 else -500) for r in scored if r["prob"] >= 0.3) / total
                missed = [r for r in models[n].predict(table.where((F.col(column) == job.held) & F.col("clase01").isNull()), rounds=k).collect()
                          if r["prob"] >= 0.3]
                assert dict(((m, r), v) for m, r, v in log)[n, k] == (None if missed else pytest.approx(want))


def test_kept_margins_and_gathered_sums_change_nothing(table, monkeypatch):
    p = B.Params(rounds=6, eta=0.3, max_depth=4)
    want = sorted(tuple(r) for r in B.fit(table, FEATURES, p).predict(table).collect())
    monkeypatch.setattr(B, "KEEP", 1)
    monkeypatch.setattr(B, "GATHER_BYTES", 1)
    monkeypatch.setattr(B, "TASK_ROWS", 50)
    monkeypatch.setattr(B, "MODEL_BYTES", 1)
    got = sorted(tuple(r) for r in B.fit(table, FEATURES, p).predict(table).collect())
    assert [i for i, _ in got] == [i for i, _ in want] and [x for _, x in got] == pytest.approx([x for _, x in want])


def test_histograms_stay_on_the_executors(table, monkeypatch):
    """A pass brings the driver one narrow row per open node, not the tasks' histograms; the trees are the same."""
    p = B.Params(rounds=2, eta=0.3, max_depth=4)
    want = B.fit(table, FEATURES, p)
    monkeypatch.setattr(B, "DRIVER_BYTES", 0)
    monkeypatch.setattr(B, "TASK_ROWS", 50)
    sizes, own = [], type(table).toArrow
    monkeypatch.setattr(type(table), "toArrow", lambda self: (sizes.append(own(self)), sizes[-1])[1])
    got = B.fit(table, FEATURES, p)
    assert len(sizes) == 8 and all(t.num_rows <= 8 and t.nbytes < 200 * t.num_rows for t in sizes)
    assert [(t.feature, t.cut, t.missing_left) for t in got.trees] == [(t.feature, t.cut, t.missing_left) for t in want.trees]


def test_tables_share_passes(table):
    """Two tables with bins of their own, trained together, give what each gives alone."""
    p = B.Params(rounds=3, eta=0.3, max_depth=3)
    tables = [table.where("id_cliente < 250"), table.where("id_cliente >= 100")]
    jobs = [B.Job(p, 0), B.Job(p, 1), B.Job(p)]
    both = B.train_tables([B.Table(t, FEATURES, jobs, ["fold"]) for t in tables], cutoff=0.3)
    for t, (models, log) in zip(tables, both):
        alone, entries = B.train(t, FEATURES, jobs, folds=["fold"], cutoff=0.3)
        assert [[x.feature for x in m.trees] for m in models] == [[x.feature for x in m.trees] for m in alone]
        assert sorted(log) == sorted(entries)
        wide = {r["id_cliente"]: r for r in B.predict_together(models, ["a", "b", "c"], t).collect()}
        for n, m in zip("abc", alone):
            assert all(wide[r["id_cliente"]][n] == pytest.approx(r["prob"]) for r in m.predict(t).collect())


def test_models_of_fewer_features_share_the_passes(table, monkeypatch):
    """a model that may use some features equals one trained on a table of those alone"""
    p, q = B.Params(rounds=4, eta=0.3, max_depth=3, colsample=0.6), B.Params(rounds=3, eta=0.3, max_depth=2)
    passes, one_pass = [], B._pass
    monkeypatch.setattr(B, "_pass", lambda *a: passes.append(len(a[2])) or one_pass(*a))
    models = B.train(table, FEATURES, [B.Job(p, features=["a", "c"]), B.Job(q), B.Job(q, features=["b"])])[0]
    assert len(passes) <= 4 * 3 and max(passes) == 3
    few, whole, one = (B.train(table, f, [B.Job(x)])[0][0] for f, x in ((["a", "c"], p), (FEATURES, q), (["b"], q)))
    got = B.predict_together(models, ["few", "whole", "one"], table, keep=["clase01"]).collect()
    for name, alone in (("few", few), ("whole", whole), ("one", one)):
        want = sorted((r["id_cliente"], r["clase01"] or 0, round(r["prob"], 9)) for r in alone.predict(table, keep=["clase01"]).collect())
        assert sorted((r["id_cliente"], r["clase01"] or 0, round(r[name], 9)) for r in got) == want


def test_whole_models_by_single_tasks_equal_the_passes(spark, table, monkeypatch):
    """many rounds over tables that fit into a task: the same trees, logs and stops without a pass; larger and empty tables keep the passes"""
    p, q = B.Params(rounds=12, eta=0.3, max_depth=4, colsample=0.6), B.profile_b(0.2, 9, 1.0, 5, 2)
    tables = [B.Table(table.where(c), FEATURES, [*[B.Job(p, j, 0) for j in range(3)], *[B.Job(q, j, 1, 1) for j in range(2)], B.Job(q, group=2, features=["a", "c"])],
                      ["fold", "other"]) for c in ("id_cliente < 300", "id_cliente >= 120")]
    passes, one_pass = [], B._pass
    monkeypatch.setattr(B, "_pass", lambda *a: passes.append(1) or one_pass(*a))
    for patience in (None, 2):
        want = B.train_tables(tables, cutoff=0.3, patience=patience)
        monkeypatch.setattr(B, "APART_PASSES", 1)
        count = len(passes)
        got = B.train_tables(tables, cutoff=0.3, patience=patience)
        assert len(passes) == count
        for (a, log), (b, entries) in zip(want, got):
            assert sorted(log) == sorted(entries)
            for m, n in zip(a, b):
                assert [list(t.feature) for t in m.trees] == [list(t.feature) for t in n.trees] and m.trees
                assert [list(t.cut) for t in m.trees] == [list(t.cut) for t in n.trees]
                assert [x for t in m.trees for x in t.value] == pytest.approx([x for t in n.trees for x in t.value])
            x, y = (sorted(map(tuple, m[0].nodes_frame(spark).drop("gain", "cover", "value").collect()), key=lambda r: r[:2]) for m in (a, b))
            assert x == y
        monkeypatch.undo()
        monkeypatch.setattr(B, "_pass", lambda *a: passes.append(1) or one_pass(*a))
    monkeypatch.setattr(B, "APART_PASSES", 1)
    for t, limit in ((table, 100), (table.where("id_cliente < 0"), B.APART_BYTES)):
        monkeypatch.setattr(B, "APART_BYTES", limit)
        count = len(passes)
        assert len(B.fit(t, FEATURES, B.Params(rounds=2, max_depth=2)).trees) == 2 and len(passes) > count


def test_a_table_scores_the_rows_of_each_model(table):
    p = B.Params(rounds=2, eta=0.3, max_depth=2)
    marked = table.withColumns({"even": F.col("id_cliente") % 2, "third": F.when(F.col("id_cliente") % 3 == 0, 1)})
    models = B.train(marked, FEATURES, [B.Job(p), B.Job(B.Params(rounds=3, eta=0.1, max_depth=2))])[0]
    got = B.predict_together(models, ["m", "n"], marked, keep=["even", "third"], of=["even", "third"]).collect()
    want = [{r["id_cliente"]: r["prob"] for r in m.predict(table).collect()} for m in models]
    assert len(got) == 400
    for r in got:
        assert r["m"] == (pytest.approx(want[0][r["id_cliente"]]) if r["even"] == 1 else None)
        assert r["n"] == (pytest.approx(want[1][r["id_cliente"]]) if r["third"] == 1 else None)


def test_a_task_sends_many_sums_at_once(monkeypatch):
    assert [len(x) for x in B._sent((i, b"x" * 4000) for i in range(1000))] == [1000]
    monkeypatch.setattr(B, "SEND_BYTES", 10000)
    sent = list(B._sent((i, b"x" * 4000) for i in range(10)))
    assert [len(x) for x in sent] == [3, 3, 3, 1] and [key for x in sent for key, _ in x] == list(range(10))


def test_waves_of_tasks_are_even():
    assert [B._even(n, 12) for n in (0, 1, 12, 13, 17, 24, 25)] == [1, 1, 12, 24, 24, 24, 36]


def test_stopping_by_patience(table):
    p = B.Params(rounds=40, eta=0.5, max_depth=3)
    jobs = [B.Job(p, j) for j in range(3)]
    data = table.fillna({"clase01": 0})
    whole, log = B.train(data, FEATURES, jobs, folds=["fold"], cutoff=0.3)
    mean = [sum(v for _, k, v in log if k == r) / 3 for r in range(1, 41)]
    for patience in (2, 5):
        best = next(k for k in range(40) if all(v <= mean[k] for v in mean[:k + patience + 1]) and mean[k] > max(mean[:k], default=-1e18))
        stopped, short = B.train(data, FEATURES, jobs, folds=["fold"], cutoff=0.3, patience=patience)
        assert [len(m.trees) for m in stopped] == [min(40, best + 1 + patience)] * 3
        assert sorted(short) == sorted(x for x in log if x[1] <= best + 1 + patience)


def test_a_label_of_missingness_alone_is_learned(spark):
    r = random.Random(4)
    data = [(i, None if i % 5 == 0 else r.gauss(0, 1), r.gauss(0, 1), int(i % 5 == 0)) for i in range(500)]
    df = spark.createDataFrame(data, "id_cliente long, a double, b double, clase01 int")
    m = B.fit(df, ["a", "b"], B.Params(rounds=3, eta=1.0, max_depth=1))
    assert {t.feature[0] for t in m.trees} == {0}
    assert all((r["prob"] > 0.7) == bool(r["clase01"]) for r in m.predict(df, keep=["clase01"]).collect())


def test_importance_is_a_sum_over_nodes(spark, table):
    m = B.fit(table, FEATURES, B.Params(rounds=4, eta=0.3, max_depth=3))
    nodes = m.nodes_frame(spark).collect()
    inner = [n for n in nodes if n["feature"] is not None]
    for n in inner:
        below = [x for x in nodes if x["tree"] == n["tree"] and x["node"] in (n["left"], n["right"])]
        assert len(below) == 2 and sum(x["rows"] for x in below) == n["rows"] and sum(x["cover"] for x in below) == pytest.approx(n["cover"])
    got = {r["feature"]: r for r in m.importance_frame(spark).collect()}
    assert set(got) == {n["feature"] for n in inner}
    for f, r in got.items():
        mine = [n for n in inner if n["feature"] == f]
        assert r["gain"] == pytest.approx(sum(n["gain"] for n in mine) / sum(n["gain"] for n in inner))
        assert r["cover"] == pytest.approx(sum(n["cover"] for n in mine) / sum(n["cover"] for n in inner))
        assert r["frequency"] == pytest.approx(len(mine) / len(inner))


def test_held_out_quality_matches_mllib(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator

    from contactlift.operators import metrics as M
    from contactlift.operators import model as ML
    from contactlift.plans import trials as T

    r = random.Random(11)
    data = []
    for i in range(3000):
        x = [r.gauss(0, 1) for _ in range(4)]
        if r.random() < 0.1:
            x[0] = None
        z = 1.5 * (x[0] or 0) - x[1] * x[2] + (x[3] > 0.5) - 1.5
        data.append((i, *x, int(r.random() < 1 / (1 + math.exp(-z)))))
    df = spark.createDataFrame(data, "id_cliente long, x0 double, x1 double, x2 double, x3 double, clase01 int")
    train, test, names = df.where("id_cliente < 2000").cache(), df.where("id_cliente >= 2000").cache(), ["x0", "x1", "x2", "x3"]

    def quality(preds):
        rows_ = preds.collect()
        loss = -sum(math.log(q["prob"] if q["clase01"] else 1 - q["prob"]) for q in rows_) / len(rows_)
        return M.roc_auc(preds.withColumnRenamed("clase01", "target")).first()[0], loss

    own = quality(T.fit(train, names, B.profile_a(0.1, 30, 1.0)).predict(test, keep=["clase01"]))
    other = quality(T.fit(train, names, ML.profile_a(0.1, 30, 1.0)).predict(test, keep=["clase01"]))
    assert BinaryClassificationEvaluator is not None
    assert own[0] > 0.8 and own[0] > other[0] - 0.01 and own[1] < other[1] + 0.01


def test_empty_tables_and_one_class(spark, table):
    p = B.Params(rounds=2, max_depth=2)
    none = B.fit(table.where("id_cliente < 0"), FEATURES, p)
    assert [t.feature for t in none.trees] == [[-1], [-1]]
    assert {r["prob"] for r in none.predict(table).collect()} == {0.5}
    ones = B.fit(table.withColumn("clase01", F.lit(1)), FEATURES, p)
    assert len(ones.predict(table).collect()) == 400
    assert B.fit(table, FEATURES, p).predict(table.where("id_cliente < 0")).collect() == []


def test_walk_follows_each_row():
    """every mix of bins, cuts and sides of missing values, at the ends of a byte too, against a loop over rows"""
    r = np.random.default_rng(5)
    bins = r.choice(np.array([0, 1, 2, 7, 254, 255], np.uint8), (3, 500))
    tree = B.Tree()
    tree.feature, tree.left, tree.right = [0, 1, 2, -1, 2, -1, -1, -1, -1], [1, 3, 5, -1, 7, -1, -1, -1, -1], [2, 4, 6, -1, 8, -1, -1, -1, -1]
    tree.depth, tree.value = [0, 1, 1, 2, 2, 2, 2, 3, 3], [0.0] * 9
    for cuts, sides in (([1, 255, 2, 0, 254], [True, False, True, False, False]), ([7, 1, 255, 0, 1], [False, True, True, False, True])):
        tree.cut, tree.missing_left = [*cuts, 0, 0, 0, 0], [*sides, *[False] * 4]
        want = []
        for row in bins.T:
            node = 0
            while tree.feature[node] >= 0:
                b = row[tree.feature[node]]
                node = tree.left[node] if (tree.missing_left[node] if b == 0 else b <= tree.cut[node]) else tree.right[node]
            want.append(node)
        assert B.walk(tree.arrays(), bins).tolist() == want
    assert B.walk(B.Tree().arrays(), bins).tolist() == [0] * 500


def test_cuts_of_many_features_are_found_by_several_tasks(spark, tmp_path):
    """groups of features give the cuts of one aggregate, their sketches are merged by more than one group; empty table and column"""
    names = [f"x{i}" for i in range(2 * B.GROUP_FEATURES + 3)]
    df = spark.range(0, 3000, 1, 1).selectExpr("id", *[f"if(id % 7 = {i % 7}, null, cast((id * {31 + i}) % 997 as double)) as {n}" for i, n in enumerate(names[1:], 1)],
                                               "cast(null as double) as x0")
    got = B.Binning.fit(df, names, 31)
    row = df.agg(*[F.expr(f"percentile_approx({n}, array({', '.join(repr(i / 31) for i in range(1, 31))}), 1240)").alias(n) for n in names],
                 *[F.max(n).alias(f"m_{n}") for n in names]).first()
    want = [sorted({c for c in row[n] or [] if c < row[f"m_{n}"]}) for n in names]
    assert [c.tolist() for c in got.cuts] == want and got.rows == 3000 and len(want[5]) == 30
    none = B.Binning.fit(df.where("id < 0"), names, 31)
    assert none.rows == 0 and [len(c) for c in none.cuts] == [0] * len(names)
    seen = []
    collect = type(df).collect
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(df), "collect", lambda self: seen.append(collect(self)) or seen[-1])
        B.Binning.fit(df, names, 31)
    assert len(seen[-1]) == 3


def test_a_task_holds_the_sketches_of_some_features_at_a_time(spark, monkeypatch):
    """many features of many rows take several aggregates, whose cuts are those of one; few rows or few features take one"""
    names = [f"x{i}" for i in range(3 * B.GROUP_FEATURES + 3)]
    df = spark.range(0, 900, 1, 3).selectExpr("id", *[f"if(id % 7 = {i % 7}, null, cast((id * {31 + i}) % 97 as double)) as {n}" for i, n in enumerate(names)]).cache()
    seen, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: seen.append(collect(self)) or seen[-1])
    one = B.Binning.fit(df, names, 31)
    assert [len(x) for x in seen] == [4]
    monkeypatch.setattr(B, "SKETCH_BYTES", 2 * B.GROUP_FEATURES * B.SKETCH_ROW_BYTES * 900)
    monkeypatch.setattr(B, "FEW_FEATURES", B.GROUP_FEATURES)
    several = B.Binning.fit(df, names, 31)
    assert [len(x) for x in seen] == [4, 2, 2]
    assert [c.tolist() for c in several.cuts] == [c.tolist() for c in one.cuts] and several.rows == one.rows == 900
    B.Binning.fit(df, names[:B.GROUP_FEATURES], 31)
    assert [len(x) for x in seen] == [4, 2, 2, 1]
    assert B.Binning.fit(df.where("id < 0"), names, 31).rows == 0
