"""What must hold of every model job's result, whatever the trees: each query runs the job and reduces its result to rows
that SQL derives from the input tables alone.

Which rows are scored or held out, how many of them are positive, what the root of every tree must add up to, and the grid
of seeds, folds, rounds, variants and cutoffs are recomputed in SQL. What depends on the trees is reduced to a flag: a
probability lies inside (0, 1); a profit is a sum of gains and costs that the held-out rows can give; importances add up
to 1; a best value is the best of its log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlift.operators import metrics as M
from contactlift.operators import sampling as S
from contactlift.plans import models as MQ
from contactlift.plans import trials as T
from contactlift.plans.registry import _sql_quota, _sql_rank

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

CV_FOLDS, TRIAL_FOLDS = 5, 5
GAIN, COST = 19500, 500
# Customers with their label; the held-out part of each seed's split, with its size and positives; the folds.
_ROWS = "lc as (select c_custkey as id_cliente, case when c_acctbal < 0 then 1 else 0 end as clase01 from customer)"


def _seeds(seeds) -> str:
    return f"(select unnest([{', '.join(map(str, seeds))}]) as seed)"


def _held_out(seeds) -> str:
    return f"""{_ROWS}, lcs as (select * from lc cross join {_seeds(seeds)}),
    numbered as (select *, {_sql_rank('seed', 'id_cliente', 'seed, clase01')} as rn, count(*) over (partition by seed, clase01) as n from lcs),
    held as (select seed, id_cliente, clase01 from numbered where rn > {_sql_quota('n', 0.7)}),
    trained as (select seed, id_cliente, clase01 from numbered where rn <= {_sql_quota('n', 0.7)})"""


def invariant(name: str, sql: str):
    def deco(fn):
        QUERIES[f"{name}_invariants"] = fn
        ORACLE[f"{name}_invariants"] = sql
        return fn
    return deco


def _result(name: str, spark: SparkSession, sf: str) -> DataFrame:
    return MQ.MODEL_QUERIES[name](spark, sf)


def _chance(c: str) -> Column:
    """A probability that no tree can push to the ends."""
    return F.coalesce((F.col(c) > 0) & (F.col(c) < 1), F.lit(False))


def _reachable(profit: str, n: str, positive: str) -> Column:
    """Is ``profit * n`` a * GAIN - b * COST for some a <= positive and b <= n - positive?"""
    whole = F.col(profit) * F.col(n)
    near = F.round(whole / COST)
    inside = (whole >= -COST * (F.col(n) - F.col(positive)) - 1) & (whole <= GAIN * F.col(positive) + 1)
    return F.coalesce(inside & (F.abs(whole / COST - near) < 1e-4), F.lit(False))


def _held_counts(spark: SparkSession, sf: str, seeds) -> DataFrame:
    """(seed, n_rows, n_positive) of the held-out part of each seed's split."""
    df = MQ.cards(spark, sf).select("id_cliente", "clase01")
    parts = T.parallel_map(lambda s: S.train_test_split(df, 0.7, s, ["clase01"])[1].withColumn("seed", F.lit(s)), list(seeds))
    return T._union(parts).groupBy("seed").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("clase01").alias("n_positive"))


def _scored(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf):
        return _result(name, spark, sf).select("id_cliente", "clase01", _chance("prob").alias("valid"))
    return run


for _name in ("train_profile_a", "train_profile_b"):
    invariant(_name, f"with {_held_out([S.MASTER_SEED])} select id_cliente, clase01, true as valid from held")(_scored(_name))


@invariant("predict_probs", f"with {_ROWS} select id_cliente, true as valid from lc")
def q_predict(spark, sf):
    return _result("predict_probs", spark, sf).select("id_cliente", _chance("prob_positivo").alias("valid"))


@invariant("early_stop_rounds", f"with {_held_out([S.MASTER_SEED])} select id_cliente, clase01, true as valid from held")
def q_early_stop(spark, sf):
    in_range = F.col("best_round").between(1, 2 * MQ.ROUNDS)
    return _result("early_stop_rounds", spark, sf).select("id_cliente", "clase01", (_chance("prob") & in_range).alias("valid"))


@invariant("tree_nodes", f"""with {_held_out([S.MASTER_SEED])},
    root as (select count(*) as n_rows, avg(clase01::double) as p from trained)
    select profile, t.tree, n_rows, n_rows as leaf_rows, true as children_add_up,
        case when t.tree = 0 then round(n_rows * p * (1 - p), 6) end as root_cover
    from root cross join (select unnest(range({MQ.ROUNDS}))::integer as tree) t cross join (select unnest(['a', 'b']) as profile)""")
def q_nodes(spark, sf):
    """The trees of both profiles as nodes: leaves tile the training rows, two children hold their parent's rows, and the
    first root's cover is the sum of the hessians at the base score."""
    df = MQ.cards(spark, sf)
    train, _ = MQ.split(df)
    out = []
    for profile, params in (("a", MQ.est_a(rounds=MQ.ROUNDS)), ("b", MQ.est_b(rounds=MQ.ROUNDS))):
        nodes = T.fit(train, MQ.feats(df), params).nodes_frame(spark)
        child = nodes.select("tree", F.col("node").alias("at"), F.col("rows").alias("child_rows"))
        pairs = (nodes.where("feature is not null").select("tree", "rows", F.explode(F.array("left", "right")).alias("at"))
                 .join(child, ["tree", "at"]).groupBy("tree").agg((F.sum("rows") == 2 * F.sum("child_rows")).alias("children_add_up")))
        trees = nodes.groupBy("tree").agg(
            F.max(F.when(F.col("node") == 0, F.col("rows"))).alias("n_rows"),
            F.sum(F.when(F.col("feature").isNull(), F.col("rows"))).alias("leaf_rows"),
            F.max(F.when((F.col("node") == 0) & (F.col("tree") == 0), F.round("cover", 6))).alias("root_cover"))
        out.append(trees.join(pairs, "tree", "left").withColumns(
            {"profile": F.lit(profile), "children_add_up": F.coalesce("children_add_up", F.lit(True))}))
    return T._union(out)


_SHARES = "select m as measure, true as adds_up, true as known from (select unnest(['gain', 'cover', 'frequency']) as m)"


def _shares(name: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf):
        known = F.col("feature").isin(MQ.feats(MQ.cards(spark, sf)))
        each = _result(name, spark, sf).select(known.alias("known"), F.explode(F.create_map(
            *[x for m in ("gain", "cover", "frequency") for x in (F.lit(m), F.col(m))])).alias("measure", "share"))
        return each.groupBy("measure").agg((F.abs(F.sum("share") - 1) < 1e-6).alias("adds_up"), F.bool_and("known").alias("known"))
    return run


for _name in ("feature_importance", "export_importance"):
    invariant(_name, _SHARES)(_shares(_name))


@invariant("train_score_workflow", f"with {_held_out([S.MASTER_SEED])} select count(*) as n_rows, sum(clase01)::bigint as n_positive, "
           "true as reachable from held")
def q_workflow(spark, sf):
    got = _result("train_score_workflow", spark, sf).select("profit", F.lit(S.MASTER_SEED).alias("seed"))
    return got.join(_held_counts(spark, sf, [S.MASTER_SEED]), "seed").select(
        "n_rows", "n_positive", _reachable("profit", "n_rows", "n_positive").alias("reachable"))


_FOLD_SQL = f"""with {_ROWS}, folded as (select *, ({_sql_rank(S.MASTER_SEED, 'id_cliente', 'clase01')} - 1) % {CV_FOLDS} as fold from lc),
    sizes as (select fold, count(*) as n_rows, sum(clase01)::bigint as n_positive from folded group by fold)"""


@invariant("cv_profit_log", f"""{_FOLD_SQL} select fold::integer as fold, iter::integer as iter, n_rows, n_positive, true as reachable
    from sizes cross join (select unnest(range(1, {MQ.ROUNDS + 1})) as iter)""")
def q_cv_log(spark, sf):
    df = MQ.cards(spark, sf).select("id_cliente", "clase01")
    sizes = S.stratified_folds(df, CV_FOLDS, S.MASTER_SEED, ["clase01"]).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("clase01").alias("n_positive"))
    return _result("cv_profit_log", spark, sf).join(sizes, "fold").select(
        F.col("fold").cast("int"), F.col("iter").cast("int"), "n_rows", "n_positive",
        _reachable("profit", "n_rows", "n_positive").alias("reachable"))


@invariant("cv_best_score", "select true as is_best, true as is_first")
def q_cv_best(spark, sf):
    """The best round of a log against every round of the same log."""
    df = MQ.cards(spark, sf)
    log = T.cv_profit_log(df, MQ.feats(df), MQ.est_b(), k=CV_FOLDS)
    best = T.cv_best_score(log).first()
    rounds = T.cv_summary(log)
    return rounds.agg((F.max("test_mean") == best["best_score"]).alias("is_best"),
                      (F.min(F.when(F.col("test_mean") == best["best_score"], F.col("iter"))) == best["best_iter"]).alias("is_first"))


@invariant("baseline_scoring_run", f"with {_held_out([S.MASTER_SEED])} select id_cliente, true as valid, true as by_cutoff from held")
def q_baseline_run(spark, sf):
    by_cutoff = F.col("contacted") == (F.col("prob_positivo") > 0.025)
    return _result("baseline_scoring_run", spark, sf).select("id_cliente", _chance("prob_positivo").alias("valid"), by_cutoff.alias("by_cutoff"))


@invariant("blended_delivery", "select true as all_held_out, true as all_different")
def q_delivery(spark, sf):
    """Every delivered id is a held-out customer, once."""
    ids = _result("blended_delivery", spark, sf)
    held = MQ.split(MQ.cards(spark, sf).select("id_cliente", "clase01"))[1].select("id_cliente", F.lit(True).alias("known"))
    return ids.join(held, "id_cliente", "left").agg(
        F.coalesce(F.bool_and(F.coalesce("known", F.lit(False))), F.lit(True)).alias("all_held_out"),
        (F.count("id_cliente") == F.count_distinct("id_cliente")).alias("all_different"))


def _grid(names, column: str) -> str:
    return f"(select unnest([{', '.join(repr(n) for n in names)}]) as {column})"


def _comparison_sql(variants, seeds) -> str:
    return f"""with {_held_out(seeds)}, sizes as (select seed, count(*) as n_rows, sum(clase01)::bigint as n_positive from held group by seed)
    select seed, variant, n_rows, n_positive, true as reachable, true as related from sizes cross join {_grid(variants, 'variant')}"""


def _comparison(name: str, baseline: str, seeds) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, sf):
        got = _result(name, spark, sf)
        base = got.where(F.col("variant") == baseline).select("seed", F.col("profit").alias("base"))
        related = F.when(F.col("base") == 0, F.col("pct_of_baseline").isNull()).otherwise(
            F.abs(F.col("pct_of_baseline") * F.col("base") - 100 * F.col("profit")) <= 1e-6 * (1 + F.abs("profit")))
        return got.join(base, "seed").join(_held_counts(spark, sf, seeds), "seed").select(
            "seed", "variant", "n_rows", "n_positive", _reachable("profit", "n_rows", "n_positive").alias("reachable"),
            F.coalesce(related, F.lit(False)).alias("related"))
    return run


invariant("feature_pack_comparison", _comparison_sql(["none", "std", "extended"], MQ.PACK_SEEDS))(
    _comparison("feature_pack_comparison", "none", MQ.PACK_SEEDS))
invariant("model_comparison", _comparison_sql(["baseline", "profile_a", "profile_b", "blend"], MQ.SEEDS))(
    _comparison("model_comparison", "baseline", MQ.SEEDS))

_ONE_SPLIT = f"""with {_held_out([S.MASTER_SEED])}, sizes as (select count(*) as n_rows, sum(clase01)::bigint as n_positive from held)"""


def _one_split(got: DataFrame, spark, sf) -> DataFrame:
    counts = _held_counts(spark, sf, [S.MASTER_SEED]).drop("seed").first()  # one row
    return got.withColumns({"n_rows": F.lit(counts["n_rows"]), "n_positive": F.lit(counts["n_positive"])}).withColumn(
        "reachable", _reachable("profit", "n_rows", "n_positive")).drop("profit")


@invariant("holdout_comparison", f"""{_ONE_SPLIT} select seed, model, n_rows, n_positive, true as reachable
    from sizes cross join {_seeds(MQ.SEEDS)} cross join {_grid(['baseline', 'blend'], 'model')}""")
def q_holdout(spark, sf):
    return _one_split(_result("holdout_comparison", spark, sf), spark, sf)


@invariant("tuned_comparison", f"""{_ONE_SPLIT} select variant, n_rows, n_positive, true as reachable
    from sizes cross join {_grid(['default_raw', 'tuned_raw', 'default_std'], 'variant')}""")
def q_tuned(spark, sf):
    return _one_split(_result("tuned_comparison", spark, sf), spark, sf)


@invariant("cutoff_sweep_experiment", f"""with {_held_out(MQ.SEEDS)}, n as (select seed, count(*) as n, sum(clase01) as p from held group by seed),
    bounds as (select round(avg(-{COST} * (n - p) / n::double), 6) as lowest, round(avg({GAIN} * p / n::double), 6) as highest from n)
    select cutoff_index::integer as cutoff_index, lowest, highest, true as inside from bounds cross join (select unnest(range(201)) as cutoff_index)""")
def q_sweep(spark, sf):
    """Every cutoff of the sweep, its mean profit between the worst and the best that the held-out rows allow."""
    bounds = _held_counts(spark, sf, MQ.SEEDS).agg(
        F.avg(-COST * (F.col("n_rows") - F.col("n_positive")) / F.col("n_rows")).alias("l"),
        F.avg(GAIN * F.col("n_positive") / F.col("n_rows")).alias("h")).first()  # one row
    cutoff_index = F.round((F.col("cutoff") - 0.01) / 0.0002).cast("int")
    return _result("cutoff_sweep_experiment", spark, sf).select(
        cutoff_index.alias("cutoff_index"), F.round(F.lit(bounds["l"]), 6).alias("lowest"), F.round(F.lit(bounds["h"]), 6).alias("highest"),
        F.col("avg_gain").between(bounds["l"] - 1e-6, bounds["h"] + 1e-6).alias("inside"))


@invariant("oof_score_table", f"with {_ROWS} select id_cliente, {len(MQ.OOF_GRID)} as n_models, true as valid from lc")
def q_oof(spark, sf):
    """Every customer has one out-of-fold probability of each parameter set."""
    got = _result("oof_score_table", spark, sf)
    names = [c for c in got.columns if c.startswith("modelito_")]
    valid = F.forall(F.array(*names), lambda x: F.coalesce((x > 0) & (x < 1), F.lit(False)))
    return got.select("id_cliente", F.lit(len(names)).alias("n_models"), valid.alias("valid"))


@invariant("trial_evaluation", f"""with {_ROWS}, n as (select count(*) as n, sum(clase01) as p from lc)
    select trial_id, eta, colsample_bytree, {len(MQ.SEEDS)}::bigint as n_seeds, true as inside
    from n cross join (values (1, 0.04::double, 0.6::double), (2, 0.0245::double, 0.212::double)) t(trial_id, eta, colsample_bytree)""")
def q_trials(spark, sf):
    n = MQ.cards(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.sum("clase01").alias("p")).first()  # one row
    most = GAIN * (n["p"] // TRIAL_FOLDS + 1) / (n["n"] // TRIAL_FOLDS)
    return _result("trial_evaluation", spark, sf).select(
        "trial_id", "eta", "colsample_bytree", "n_seeds", F.col("y").between(-float(COST), most).alias("inside"))


_VECTORS = f"""with lc as (select vec_id as id_cliente, case when label = 0 then 1 else 0 end as clase01 from embeddings),
    numbered as (select *, {_sql_rank(S.MASTER_SEED, 'id_cliente', 'clase01')} as rn, count(*) over (partition by clase01) as n from lc)
    select id_cliente, clase01, true as valid from numbered where rn > {_sql_quota('n', 0.7)}"""
invariant("train_profile_a_vectors", _VECTORS)(_scored("train_profile_a_vectors"))
