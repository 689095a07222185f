"""Registered queries: one Spark builder per operator of the inventory, plus its DuckDB oracle.

Every builder reads the driver's tables in ``sf_dir`` (through the fixtures) over whole tables.
Outputs that can hold NaN or Inf give the finite value (else NULL) plus an ``__ieee`` class flag,
and averages whose summation order differs between engines are rounded to 6 places.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contactlift.functions import rowwise as rw
from contactlift.operators import metrics as M
from contactlift.operators import packs as P
from contactlift.operators import projections as PR
from contactlift.operators import sampling as S
from contactlift.operators.ranking import row_numbers
from contactlift.plans import fixtures as FX
from contactlift.plans.sqltext import dbl, finite, ieee, pack_sql, sql_ratio
from contactlift.sources import files as IO
from contactlift.session import scratch_path

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}

# Fixed values used by the registered queries.
SEEDS = (19381, 19387, 19391, 19403, 19417)  # five fixed seeds
SPLIT_FRACTION = 0.7
UNDERSAMPLING = 0.2
FOLDS = 5
MONTH = 199707
ROUND = 6


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def scored_views(*extra: str) -> dict[str, str]:
    views = {"f_scored": FX.scored_sql(7919)}
    if "alt" in extra:
        views["f_scored_alt"] = FX.scored_sql(6101)
    return views


def _labelled_cards(spark: SparkSession, sf: str) -> DataFrame:
    return PR.label_from_class(FX.cards(spark, sf))


LABELLED_CARDS_SQL = FX.with_views(
    "select * exclude (clase), case when clase = 'SI' then 1 else 0 end as clase01 from f_cards",
    f_cards=FX.CARDS_SQL)
CARDS_VIEW = {"f_cards": FX.CARDS_SQL}


def _sql_rank(seed_expr: str, id_col: str, partition: str) -> str:
    return (f"row_number() over (partition by {partition} order by md5(cast({seed_expr} as varchar) || ':' || "
            f"cast({id_col} as varchar)), {id_col})")


def _sql_uniform(seed_expr: str, id_col: str) -> str:
    h = f"md5(cast({seed_expr} as varchar) || ':' || cast({id_col} as varchar))"
    return f"(('0x' || substr({h}, 1, 8))::bigint / {dbl(4294967296.0)})"


def _sql_quota(n: str, fraction: float) -> str:
    return f"cast(round_even(cast({n} as double) * {dbl(fraction)}, 0) as bigint)"


# ================================ 2.5 aggregations / 2.6 windows ================================

register("profit_score", FX.with_views(
    f"""select grp, cast(coalesce(sum(case when prob >= {dbl(M.CUTOFF)} then case when target = 1 then 19500
        else -500 end end), 0) as bigint) / count(*) as profit from f_scored group by grp""", **scored_views()))(
    lambda spark, sf: M.profit_score(FX.scored(spark, sf), M.CUTOFF, by=["grp"]))

register("profit_absolute", FX.with_views(
    f"""select grp, cast(coalesce(sum(case when prob > {dbl(M.CUTOFF)} then case when target = 1 then 19500
        else -500 end end), 0) as bigint) as profit from f_scored group by grp""", **scored_views()))(
    lambda spark, sf: M.profit_absolute(FX.scored(spark, sf), M.CUTOFF, by=["grp"]))

_RATES = (1.0, 0.5, UNDERSAMPLING)


@register("breakeven_cutoff", FX.with_views(
    " union all ".join(
        f"""select grp, {dbl(u)} as undersampling, {dbl(rw.breakeven_cutoff(undersampling=u))} as cutoff,
        cast(coalesce(sum(case when prob > {dbl(rw.breakeven_cutoff(undersampling=u))} then case when target = 1
        then 19500 else -500 end end), 0) as bigint) as profit from f_scored group by grp""" for u in _RATES),
    **scored_views()))
def q_breakeven(spark, sf):
    df = FX.scored(spark, sf)
    aggs, structs = [], []
    for i, u in enumerate(_RATES):
        c = rw.breakeven_cutoff(undersampling=u)
        pts = F.sum(F.when(F.col("prob") > F.lit(c), M.points("target")))
        aggs.append(F.coalesce(pts, F.lit(0).cast("bigint")).alias(f"p{i}"))
        structs.append(F.struct(F.lit(u).alias("undersampling"), F.lit(c).alias("cutoff"), F.col(f"p{i}").alias("profit")))
    # one pass computes the profit at every cutoff, then the rows are unnested
    return df.groupBy("grp").agg(*aggs).select("grp", F.inline(F.array(*structs)))


register("label_mean", FX.with_views("select avg(cast(clase01 as double)) as label_mean from lc",
                                     lc=LABELLED_CARDS_SQL))(
    lambda spark, sf: M.label_mean(_labelled_cards(spark, sf)))

register("cumulative_gain", FX.with_views(
    """select id, grp, prob, target, cast(sum(case when target = 1 then 19500 else -500 end)
       over (order by prob desc nulls last, id rows between unbounded preceding and current row) as bigint) as gain
       from f_scored""", **scored_views()))(
    lambda spark, sf: M.cumulative_gain(FX.scored(spark, sf)))

register("cumulative_gain_ties", FX.with_views(
    """select prob, n, cast(sum(points) over (order by prob desc nulls last rows between unbounded preceding
       and current row) as bigint) as gain, cast(sum(n) over (order by prob desc nulls last rows between
       unbounded preceding and current row) as bigint) as contacted
       from (select prob, count(*) as n, sum(case when target = 1 then 19500 else -500 end) as points
             from f_scored group by prob) g""", **scored_views()))(
    lambda spark, sf: M.gain_by_prob(FX.scored(spark, sf)))

_ROC_COUNTS = """c as (select prob, pos, neg,
       sum(pos) over (order by prob desc rows between unbounded preceding and current row) as cum_pos,
       sum(neg) over (order by prob desc rows between unbounded preceding and current row) as cum_neg
     from (select prob, sum(target) as pos, sum(1 - target) as neg from f_scored where prob is not null
           group by prob) g)"""

register("roc_auc", FX.with_views(
    f"""with {_ROC_COUNTS}
    select sum(neg * (cum_pos - pos / 2.0::double)) / cast(sum(pos) * sum(neg) as double) as auc,
           cast(sum(pos) as bigint) as n_pos, cast(sum(neg) as bigint) as n_neg from c""", **scored_views()))(
    lambda spark, sf: M.roc_auc(FX.scored(spark, sf)))

register("roc_curve", FX.with_views(
    f"""with {_ROC_COUNTS}
    select prob as cutoff, cum_neg / (select sum(neg) from c) as x, cum_pos / (select sum(pos) from c) as y from c
    union all select null, 0.0::double, 0.0::double""", **scored_views()))(
    lambda spark, sf: M.roc_curve(FX.scored(spark, sf)))

_SWEEP_SQL = """select i as cutoff_index, cast(100 + 2 * i as double) / 10000 as cutoff,
       cast(coalesce(sum(case when s.prob >= cast(100 + 2 * i as double) / 10000 then
            case when s.target = 1 then 19500 else -500 end end), 0) as bigint) / count(*) as profit
    from (select cast(range as integer) as i from range(201)) cuts cross join {src} s
    group by i"""

register("cross_cutoffs", FX.with_views(_SWEEP_SQL.format(src="f_scored"), **scored_views()))(
    lambda spark, sf: M.cutoff_sweep(FX.scored(spark, sf)))


def _seed_split_sql(fraction: float, seeds=SEEDS) -> str:
    seed_list = ", ".join(str(s) for s in seeds)
    return f"""rows_x_seeds as (select s.seed, f.* from f_scored f cross join (select unnest([{seed_list}]) as seed) s),
    ranked as (select *, {_sql_rank('seed', 'id', 'seed, target')} as rn,
                      count(*) over (partition by seed, target) as n from rows_x_seeds),
    train as (select seed, id from ranked where rn <= {_sql_quota('n', fraction)}),
    test as (select r.* from rows_x_seeds r anti join train t on r.seed = t.seed and r.id = t.id)"""


@register("mean_gain_by_cutoff", FX.with_views(
    f"""with {_seed_split_sql(SPLIT_FRACTION)},
    sweeps as (select t.seed, cast(100 + 2 * i as double) / 10000 as cutoff,
        cast(coalesce(sum(case when t.prob >= cast(100 + 2 * i as double) / 10000 then
             case when t.target = 1 then 19500 else -500 end end), 0) as bigint) / count(*) as profit
        from (select cast(range as integer) as i from range(201)) cuts cross join test t group by t.seed, i)
    select cutoff, round(avg(profit), {ROUND}) as avg_gain from sweeps group by cutoff""", **scored_views()))
def q_mean_gain_by_cutoff(spark, sf):
    rows = S.cross_seed_rows(FX.scored(spark, sf), SEEDS)
    # ids are unique within a seed: the test part is the complement of the marked sample
    marked = S.mark_sample(rows, SPLIT_FRACTION, ["seed", "target"], seed="seed", id_col="id")
    test = marked.where(~F.col("__in_sample")).drop("__in_sample")
    sweeps = M.cutoff_sweep(test, by=["seed"])
    out = M.mean_gain_by_cutoff(sweeps)
    return out.select("cutoff", F.round("avg_gain", ROUND).alias("avg_gain"))


register("group_frequency", """select o_orderstatus, o_orderpriority, count(*) as n,
    count(*) / sum(count(*)) over (partition by o_orderstatus) as freq
    from orders group by o_orderstatus, o_orderpriority""")(
    lambda spark, sf: M.group_frequency(FX.table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"]))

register("share_within_parent", """select l_returnflag, l_linestatus, count(*) as n,
    count(*) / sum(count(*)) over (partition by l_returnflag) as share
    from lineitem group by l_returnflag, l_linestatus""")(
    lambda spark, sf: M.share_within_parent(
        FX.table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n")),
        ["l_returnflag"]))

_CV_SUMMARY_SQL = """summary as (select seed, iter, avg(cell) as test_mean, stddev_pop(cell) as test_std
    from (select seed, iter, fold, avg(profit) as cell from f_cvlog group by seed, iter, fold) c group by seed, iter)"""
CV_VIEW = {"f_cvlog": FX.CVLOG_SQL}


def _cv_summary(spark, sf) -> DataFrame:
    return M.cv_fold_summary(FX.cvlog(spark, sf), by=["seed"])


def _rounded(df: DataFrame, cols) -> DataFrame:
    return df.withColumns({c: F.round(c, ROUND) for c in cols})


register("cv_fold_summary", FX.with_views(
    f"with {_CV_SUMMARY_SQL} select seed, iter, round(test_mean, {ROUND}) as test_mean, "
    f"round(test_std, {ROUND}) as test_std from summary", **CV_VIEW))(
    lambda spark, sf: _rounded(_cv_summary(spark, sf), ["test_mean", "test_std"]))

register("mean_by_iteration", FX.with_views(
    f"with {_CV_SUMMARY_SQL} select iter, round(avg(test_mean), {ROUND}) as mean_profit, "
    f"round(avg(test_std), {ROUND}) as mean_std from summary group by iter", **CV_VIEW))(
    lambda spark, sf: _rounded(M.mean_by_iteration(_cv_summary(spark, sf)), ["mean_profit", "mean_std"]))

register("top5_mean", FX.with_views(
    f"""with {_CV_SUMMARY_SQL}
    select seed, round(avg(test_mean), {ROUND}) as top_mean, round(avg(cast(iter as double)), {ROUND}) as iter_mean,
           round(stddev_samp(cast(iter as double)), {ROUND}) as iter_sd
    from (select *, row_number() over (partition by seed order by test_mean desc, iter desc) as r from summary) t
    where r <= 5 group by seed""", **CV_VIEW))(
    lambda spark, sf: _rounded(M.top5_mean(_cv_summary(spark, sf)), ["top_mean", "iter_mean", "iter_sd"]))

register("seed_mean", FX.with_views(
    f"with {_CV_SUMMARY_SQL} select iter, round(avg(test_mean), {ROUND}) as y, count(*) as n_seeds "
    f"from summary group by iter", **CV_VIEW))(
    lambda spark, sf: _rounded(M.seed_mean(_cv_summary(spark, sf).withColumnRenamed("test_mean", "y"), ["iter"]),
                               ["y"]))

TRIAL_LIMIT = 50.0
register("filter_trials", FX.with_views(
    f"with {_CV_SUMMARY_SQL} select seed, iter, round(test_mean, {ROUND}) as y from summary "
    f"where test_mean > {dbl(TRIAL_LIMIT)}", **CV_VIEW))(
    lambda spark, sf: _rounded(_cv_summary(spark, sf).where(F.col("test_mean") > F.lit(TRIAL_LIMIT))
                               .select("seed", "iter", F.col("test_mean").alias("y")), ["y"]))

SNAP_VIEW = {"f_snapshot": FX.SNAPSHOT_SQL}

register("distinct_months", FX.with_views("select distinct foto_mes from f_snapshot", **SNAP_VIEW))(
    lambda spark, sf: FX.snapshot(spark, sf).select("foto_mes").distinct())

register("distinct_rows", FX.with_views("select distinct numero_de_cliente, foto_mes from f_snapshot", **SNAP_VIEW))(
    lambda spark, sf: FX.snapshot(spark, sf).select("numero_de_cliente", "foto_mes").distinct())

register("table_shape", FX.with_views("select count(*) as n_rows, cast(4 as bigint) as n_cols from f_snapshot",
                                      **SNAP_VIEW))(
    lambda spark, sf: IO.table_shape(FX.snapshot(spark, sf)))

register("rank_within_stratum", FX.with_views(
    f"select id_cliente, clase, cast({_sql_rank(S.MASTER_SEED, 'id_cliente', 'clase')} as bigint) as rn from f_cards",
    **CARDS_VIEW))(
    lambda spark, sf: row_numbers(
        FX.cards(spark, sf).select("id_cliente", "clase").withColumn("__h", rw.hash_key(S.MASTER_SEED, "id_cliente")),
        [F.asc("__h"), F.asc("id_cliente")], "rn", partition_by=["clase"]).drop("__h"))

# ================================ 2.2 projections ================================

_DAYS_SQL = ("date_diff('day', try_strptime(cast(fecha as varchar), '%Y%m%d')::date, "
             "(strptime(cast(foto_mes as varchar) || '01', '%Y%m%d') + interval 1 month)::date)")

register("days_to_snapshot_end", FX.with_views(
    f"select numero_de_cliente, o_orderkey, foto_mes, fecha, cast({_DAYS_SQL} as integer) as dias from f_snapshot",
    **SNAP_VIEW))(
    lambda spark, sf: FX.snapshot(spark, sf).withColumn("dias", rw.days_to_snapshot_end("foto_mes", "fecha")))

register("label_from_class", LABELLED_CARDS_SQL)(lambda spark, sf: _labelled_cards(spark, sf))

register("select_by_pattern", FX.with_views(
    "select id_cliente, Master_msaldototal, Master_tconsumos, Master_mlimitecompra, Master_mpagominimo from f_cards",
    **CARDS_VIEW))(
    lambda spark, sf: PR.select_by_pattern(FX.cards(spark, sf), drop=["clase"], drop_pattern=r"^visa_"))

register("label_and_id_columns", FX.with_views("select id_cliente, clase01 from lc", lc=LABELLED_CARDS_SQL))(
    lambda spark, sf: PR.label_and_id_columns(_labelled_cards(spark, sf)))


def _pair_sql(fn: str) -> str:
    return FX.with_views(f"select id_cliente, {fn} from f_cards", **CARDS_VIEW)


def _nn(x: str) -> str:
    return f"(case when isnan(cast({x} as double)) then null else cast({x} as double) end)"


register("row_max_narm", _pair_sql(
    f"greatest({_nn('Master_mlimitecompra')}, {_nn('Visa_mlimitecompra')}) as max2, "
    f"greatest({_nn('Master_msaldototal')}, {_nn('Visa_msaldototal')}, {_nn('Master_mlimitecompra')}, "
    f"{_nn('Visa_mlimitecompra')}) as max4"))(
    lambda spark, sf: FX.cards(spark, sf).select(
        "id_cliente", rw.row_max_narm("Master_mlimitecompra", "Visa_mlimitecompra").alias("max2"),
        rw.row_max_narm("Master_msaldototal", "Visa_msaldototal", "Master_mlimitecompra",
                        "Visa_mlimitecompra").alias("max4")))

register("row_min_narm", _pair_sql(f"least({_nn('Master_mpagominimo')}, {_nn('Visa_mpagominimo')}) as min2"))(
    lambda spark, sf: FX.cards(spark, sf).select(
        "id_cliente", rw.row_min_narm("Master_mpagominimo", "Visa_mpagominimo").alias("min2")))

register("row_sum_narm", _pair_sql(
    f"(coalesce({_nn('Master_msaldototal')}, 0.0::double) + coalesce({_nn('Visa_msaldototal')}, 0.0::double)) as sum2, "
    f"(coalesce({_nn('Master_tconsumos')}, 0.0::double) + coalesce({_nn('Visa_tconsumos')}, 0.0::double) + "
    f"coalesce({_nn('Master_mpagominimo')}, 0.0::double)) as sum3"))(
    lambda spark, sf: FX.cards(spark, sf).select(
        "id_cliente", rw.row_sum_narm("Master_msaldototal", "Visa_msaldototal").alias("sum2"),
        rw.row_sum_narm("Master_tconsumos", "Visa_tconsumos", "Master_mpagominimo").alias("sum3")))

_MEAN_CNT = (f"((case when {_nn('Master_msaldototal')} is not null then 1 else 0 end) + "
             f"(case when {_nn('Visa_msaldototal')} is not null then 1 else 0 end))")
register("row_mean_narm", _pair_sql(
    f"(case when {_MEAN_CNT} > 0 then (coalesce({_nn('Master_msaldototal')}, 0.0::double) + "
    f"coalesce({_nn('Visa_msaldototal')}, 0.0::double)) / {_MEAN_CNT} end) as mean2"))(
    lambda spark, sf: FX.cards(spark, sf).select(
        "id_cliente", rw.row_mean_narm("Master_msaldototal", "Visa_msaldototal").alias("mean2")))


def _ratio_sql(n: str, d: str, name: str) -> str:
    r = sql_ratio(n, d)
    return f"{finite(r)} as {name}, cast({ieee(r)} as integer) as {name}__ieee"


@register("safe_ratio", _pair_sql(
    _ratio_sql("Master_msaldototal", "Visa_msaldototal", "r_saldo") + ", "
    + _ratio_sql("Master_tconsumos", "Visa_tconsumos", "r_consumos")))
def q_safe_ratio(spark, sf):
    c = FX.cards(spark, sf)
    r1 = rw.safe_ratio("Master_msaldototal", "Visa_msaldototal")
    r2 = rw.safe_ratio("Master_tconsumos", "Visa_tconsumos")
    return c.select("id_cliente", rw.finite_or_null(r1).alias("r_saldo"), rw.ieee_class(r1).alias("r_saldo__ieee"),
                    rw.finite_or_null(r2).alias("r_consumos"), rw.ieee_class(r2).alias("r_consumos__ieee"))


def pack_output(df: DataFrame, pack: str, id_col: str = "id_cliente") -> DataFrame:
    """The compared projection of a pack: finite values plus a class flag for every ratio."""
    enriched = P.apply_pack(df, pack)
    cols = [f"`{id_col}`"]
    for name, op in P.pack_ops(pack).items():
        x = f"`{name}`"
        cols.append(f"case when isnan({x}) or abs({x}) = double('Infinity') then null else {x} end as {x}")
        if op == "ratio":
            cols.append(f"case when {x} is null then null when isnan({x}) then 3 when {x} = double('Infinity') "
                        f"then 1 when {x} = double('-Infinity') then 2 else 0 end as `{name}__ieee`")
    return enriched.selectExpr(*cols)


def _pack_query(pack: str) -> Builder:
    def build(spark: SparkSession, sf: str) -> DataFrame:
        return pack_output(FX.wide(spark, sf), pack)
    return build


for _pack in ("std", "small_extended", "extended", "combined"):
    register(f"enrich_{_pack}", FX.with_views(pack_sql(_pack, "f_wide"), f_wide=FX.wide_sql()))(_pack_query(_pack))

register("blend_scores", FX.with_views(
    f"select a.id, {dbl(0.7)} * a.prob + {dbl(0.3)} * b.prob as prob from f_scored a join f_scored_alt b on a.id = b.id",
    **scored_views("alt")))(
    lambda spark, sf: PR.blend_scores(FX.scored(spark, sf), FX.scored(spark, sf, 6101), weight=0.7, right_weight=0.3))


def _variant_profits(spark, sf) -> DataFrame:
    base = M.profit_score(FX.scored(spark, sf), by=["grp"], name="score_base")
    alt = M.profit_score(FX.scored(spark, sf, 6101), by=["grp"], name="score_alt")
    blend = PR.blend_scores(FX.scored(spark, sf), FX.scored(spark, sf, 6101), weight=0.7, right_weight=0.3)
    blend = blend.join(FX.scored(spark, sf).select("id", "grp", "target"), "id")
    bl = M.profit_score(blend, by=["grp"], name="score_blend")
    return base.join(alt, "grp").join(bl, "grp")


_VARIANTS_SQL = f"""v as (select a.grp,
    cast(coalesce(sum(case when a.prob >= {dbl(0.025)} then case when a.target = 1 then 19500 else -500 end end), 0) as bigint) / count(*) as score_base,
    cast(coalesce(sum(case when b.prob >= {dbl(0.025)} then case when a.target = 1 then 19500 else -500 end end), 0) as bigint) / count(*) as score_alt,
    cast(coalesce(sum(case when {dbl(0.7)} * a.prob + {dbl(0.3)} * b.prob >= {dbl(0.025)} then case when a.target = 1 then 19500 else -500 end end), 0) as bigint) / count(*) as score_blend
    from f_scored a join f_scored_alt b on a.id = b.id group by a.grp)"""

register("relative_to_baseline", FX.with_views(
    f"with {_VARIANTS_SQL} select grp, score_base / score_base * {dbl(100)} as score_base, "
    f"score_alt / score_base * {dbl(100)} as score_alt, score_blend / score_base * {dbl(100)} as score_blend from v",
    **scored_views("alt")))(
    lambda spark, sf: PR.relative_to_baseline(_variant_profits(spark, sf), "score_base", r"^score_", keep=["grp"]))

register("uniform_sample_column", FX.with_views(
    f"select id_cliente, {_sql_uniform(S.MASTER_SEED, 'id_cliente')} as sample from f_cards", **CARDS_VIEW))(
    lambda spark, sf: S.uniform_sample_column(FX.cards(spark, sf).select("id_cliente"), S.MASTER_SEED))

_LIST_CUTS = (0.02, 0.025, 0.03)


@register("explode_results", FX.with_views(" union all ".join(
    f"""select grp, {dbl(c)} as cutoff, cast(coalesce(sum(case when prob >= {dbl(c)} then case when target = 1
        then 19500 else -500 end end), 0) as bigint) / count(*) as profit from f_scored group by grp"""
    for c in _LIST_CUTS), **scored_views()))
def q_explode(spark, sf):
    df = FX.scored(spark, sf)
    n = F.count(F.lit(1))
    elems = [F.struct(F.lit(c).alias("cutoff"),
                      (F.coalesce(F.sum(F.when(F.col("prob") >= F.lit(c), M.points("target"))),
                                  F.lit(0).cast("bigint")) / n).alias("profit")) for c in _LIST_CUTS]
    nested = df.groupBy("grp").agg(F.array(*elems).alias("results"))
    return PR.explode_results(nested, "results")


# ================================ 2.3 filters ================================

register("filter_cutoff_inclusive", FX.with_views(
    f"select * from f_scored where prob >= {dbl(0.025)}", **scored_views()))(
    lambda spark, sf: PR.filter_cutoff_inclusive(FX.scored(spark, sf), 0.025))

register("filter_cutoff_strict", FX.with_views(
    f"select * from f_scored where prob > {dbl(0.025)}", **scored_views()))(
    lambda spark, sf: PR.filter_cutoff_strict(FX.scored(spark, sf), 0.025))

register("filter_month", FX.with_views(f"select * from f_snapshot where foto_mes = cast('{MONTH}' as integer)",
                                       **SNAP_VIEW))(
    lambda spark, sf: IO.snapshot_extract(FX.snapshot(spark, sf), str(MONTH)))

_FOLDS_SQL = f"""folded as (select *, cast(({_sql_rank(S.MASTER_SEED, 'id_cliente', 'clase01')} - 1) % {FOLDS} as integer)
    as fold, {_sql_uniform(S.MASTER_SEED, 'id_cliente')} as sample from lc)"""


def _folded_cards(spark, sf) -> DataFrame:
    lc = _labelled_cards(spark, sf)
    return S.uniform_sample_column(S.stratified_folds(lc, FOLDS, S.MASTER_SEED), S.MASTER_SEED)


register("stratified_folds", FX.with_views(f"with {_FOLDS_SQL} select id_cliente, clase01, fold from folded",
                                           lc=LABELLED_CARDS_SQL))(
    lambda spark, sf: S.stratified_folds(_labelled_cards(spark, sf), FOLDS, S.MASTER_SEED).select(
        "id_cliente", "clase01", "fold"))

register("undersample_majority", FX.with_views(
    f"with {_FOLDS_SQL} select id_cliente, clase01, fold, sample from folded where fold <> 0 and "
    f"(sample < {dbl(UNDERSAMPLING)} or clase01 = 1)", lc=LABELLED_CARDS_SQL))(
    lambda spark, sf: S.undersample_majority(_folded_cards(spark, sf), UNDERSAMPLING, fold=0).select(
        "id_cliente", "clase01", "fold", "sample"))

register("fold_complement", FX.with_views(
    f"with {_FOLDS_SQL} select id_cliente, clase01, fold from folded where fold <> 0", lc=LABELLED_CARDS_SQL))(
    lambda spark, sf: S.fold_complement(_folded_cards(spark, sf), 0).select("id_cliente", "clase01", "fold"))

# ================================ 2.10 sampling ================================

_SAMPLE_SQL = f"""ranked as (select *, {_sql_rank(S.MASTER_SEED, 'id_cliente', 'clase')} as rn,
    count(*) over (partition by clase) as n from f_cards),
    train as (select * exclude (rn, n) from ranked where rn <= {_sql_quota('n', SPLIT_FRACTION)})"""

register("stratified_sample", FX.with_views(f"with {_SAMPLE_SQL} select * from train", **CARDS_VIEW))(
    lambda spark, sf: S.stratified_sample(FX.cards(spark, sf), SPLIT_FRACTION, ["clase"], S.MASTER_SEED))

@register("train_test_split", FX.with_views(
    f"""with {_SAMPLE_SQL} select 'train' as part, * from train
    union all select 'test' as part, f.* from f_cards f anti join train t on f.id_cliente = t.id_cliente""",
    **CARDS_VIEW))
def q_split(spark, sf):
    train, test = S.train_test_split(FX.cards(spark, sf), SPLIT_FRACTION, seed=-1)
    return train.select(F.lit("train").alias("part"), "*").unionByName(test.select(F.lit("test").alias("part"), "*"))


register("anti_join_by_id", FX.with_views(
    f"with {_SAMPLE_SQL} select f.* from f_cards f anti join train t on f.id_cliente = t.id_cliente", **CARDS_VIEW))(
    lambda spark, sf: S.anti_join_by_id(
        FX.cards(spark, sf), S.stratified_sample(FX.cards(spark, sf), SPLIT_FRACTION, ["clase"], S.MASTER_SEED)))

_REPLACE_FRACTION = 0.5
register("sample_with_replacement", FX.with_views(
    f"""with ranked as (select *, {_sql_rank(S.MASTER_SEED, 'id_cliente', 'clase')} as rn,
        count(*) over (partition by clase) as n from f_cards),
    sizes as (select distinct clase, n from ranked),
    draws as (select clase, n, unnest(range(1, {_sql_quota('n', _REPLACE_FRACTION)} + 1)) as i from sizes),
    picks as (select clase, i, 1 + (('0x' || substr(md5('{S.MASTER_SEED}:' || coalesce(cast(clase as varchar), '') || ':' || cast(i as varchar)), 1, 15))::bigint % n) as pos from draws)
    select r.* exclude (rn, n) from picks p join ranked r on p.clase is not distinct from r.clase and p.pos = r.rn""",
    **CARDS_VIEW))(
    lambda spark, sf: S.sample_with_replacement(FX.cards(spark, sf), _REPLACE_FRACTION, ["clase"], S.MASTER_SEED))


@register("cross_seed_rows", FX.with_views(
    f"""with rows_x_seeds as (select s.seed, f.id_cliente, f.clase from f_cards f cross join (select unnest([{', '.join(map(str, SEEDS))}]) as seed) s),
    ranked as (select *, {_sql_rank('seed', 'id_cliente', 'seed, clase')} as rn, count(*) over (partition by seed, clase) as n from rows_x_seeds)
    select seed, id_cliente, clase from ranked where rn <= {_sql_quota('n', SPLIT_FRACTION)}""", **CARDS_VIEW))
def q_cross_seed(spark, sf):
    rows = S.cross_seed_rows(FX.cards(spark, sf).select("id_cliente", "clase"), SEEDS)
    return S.stratified_sample(rows, SPLIT_FRACTION, ["seed", "clase"], seed="seed").select("seed", "id_cliente", "clase")


# ================================ 2.4 joins / 2.8 sets ================================

register("attach_scores_by_id", FX.with_views(
    "select a.id, a.prob as prob_a, b.prob as prob_b, a.target from f_scored a join f_scored_alt b on a.id = b.id",
    **scored_views("alt")))(
    lambda spark, sf: PR.attach_scores_by_id(FX.scored(spark, sf), FX.scored(spark, sf, 6101), keep=["target"]))

_LONG_SQL = "select 100 as model_id, id, prob from f_scored union all select 101, id, prob from f_scored_alt"


def _long_scores(spark, sf) -> DataFrame:
    a = FX.scored(spark, sf).select(F.lit(100).alias("model_id"), "id", "prob")
    b = FX.scored(spark, sf, 6101).select(F.lit(101).alias("model_id"), "id", "prob")
    return a.unionByName(b)


register("union_rows", FX.with_views(_LONG_SQL, **scored_views("alt")))(_long_scores)

register("scatter_by_fold", FX.with_views(
    f"""select id, max(case when model_id = 100 then prob end) as modelito_100,
    max(case when model_id = 101 then prob end) as modelito_101 from ({_LONG_SQL}) l group by id""",
    **scored_views("alt")))(
    lambda spark, sf: PR.scatter_by_fold(_long_scores(spark, sf), [100, 101]))

# ================================ 2.7 sorts and limits ================================

register("sort_by_prob_desc", FX.with_views("select * from f_scored order by prob desc nulls last, id",
                                            **scored_views()))(
    lambda spark, sf: PR.sort_by_prob_desc(FX.scored(spark, sf)))

register("head_n", FX.with_views("select * from f_scored order by prob desc nulls last, id limit 10",
                                 **scored_views()))(
    lambda spark, sf: PR.head_n(FX.scored(spark, sf), 10, [F.desc_nulls_last(rw.present("prob")), F.asc("id")]))

register("tail_n", FX.with_views(
    f"with {_CV_SUMMARY_SQL} select seed, iter, round(test_mean, {ROUND}) as test_mean from summary "
    "order by test_mean desc, seed desc, iter desc limit 5", **CV_VIEW))(
    lambda spark, sf: _rounded(PR.tail_n(_cv_summary(spark, sf), 5, ["test_mean", "seed", "iter"])
                               .select("seed", "iter", "test_mean"), ["test_mean"]))

register("sort_snapshot", FX.with_views("select * from f_snapshot order by foto_mes, numero_de_cliente",
                                        **SNAP_VIEW))(
    lambda spark, sf: IO.sort_snapshot(FX.snapshot(spark, sf)))

# ================================ 2.1 sources and sinks ================================

register("scan_columnar", "select * from customer")(
    lambda spark, sf: IO.scan_columnar(spark, f"{sf}/customer.parquet"))


@register("scan_delimited", "select * from customer")
def q_scan_delimited(spark, sf):
    src = FX.table(spark, sf, "customer")
    path = scratch_path(spark, "tsv")
    IO.sink_delimited(src, path)
    return IO.scan_delimited(spark, path, schema=src.schema)


@register("sink_delimited", FX.with_views("select * from f_cards", **CARDS_VIEW))
def q_sink_delimited(spark, sf):
    src = FX.cards(spark, sf)
    path = scratch_path(spark, "tsv")
    IO.sink_delimited(src, path)
    return IO.scan_delimited(spark, path, schema=src.schema)


@register("sink_columnar", FX.with_views("select * from f_cards", **CARDS_VIEW))
def q_sink_columnar(spark, sf):
    path = scratch_path(spark, "parquet")
    IO.sink_columnar(FX.cards(spark, sf), path)
    return IO.scan_columnar(spark, path)


@register("convert_to_columnar", "select * from customer")
def q_convert(spark, sf):
    src = FX.table(spark, sf, "customer")
    tsv = scratch_path(spark, "tsv")
    IO.sink_delimited(src, tsv)
    out = IO.convert_to_columnar(spark, {"customer": tsv}, scratch_path(spark, "parquet"), schema=src.schema)
    return IO.scan_columnar(spark, out["customer"])


_VIEWS = {"train": "orders", "predict": "customer", "results": "supplier", "predict_full": "part"}
_VIEW_GROUPS = {"train": "o_orderstatus", "predict": "c_mktsegment", "results": "cast(s_nationkey as varchar(9))", "predict_full": "p_brand"}


@register("dataset_catalog", " union all ".join(
    f"select '{v}' as dataset, {_VIEW_GROUPS[v]} as grp, count(*) as n from {t} group by all" for v, t in _VIEWS.items()))
def q_catalog(spark, sf):
    """All four views of the catalog, each table checked against its schema when it is registered."""
    cat = IO.DatasetCatalog(spark)
    for view, name in _VIEWS.items():
        cat.register(view, f"{sf}/{name}.parquet", FX.table(spark, sf, name).schema)
    cat.as_views()
    return spark.sql(" union all ".join(
        f"select '{v}' as dataset, {g} as grp, count(*) as n from {v} group by all" for v, g in _VIEW_GROUPS.items()))


_NUMBERS = {"orders": ["o_orderkey", "o_custkey", "o_totalprice"], "customer": ["c_custkey", "c_nationkey", "c_acctbal"],
            "supplier": ["s_suppkey", "s_nationkey", "s_acctbal"], "part": ["p_partkey", "p_size", "p_retailprice"]}


@register("dataset_catalog_statistics", " union all ".join(
    f"""select '{v}' as dataset, '{c}' as "column", count(*) as n_rows, count_if({c} is null) as n_missing,
        min({c})::double as lowest, max({c})::double as highest from {t}""" for v, t in _VIEWS.items() for c in _NUMBERS[t]))
def q_catalog_statistics(spark, sf):
    """Tables stored in the catalog with their statistics; every numeric column of the four views."""
    cat = IO.DatasetCatalog(spark, root=scratch_path(spark, "catalog"))
    for view, name in _VIEWS.items():
        cat.store(view, FX.table(spark, sf, name))
    out = None
    for view in _VIEWS:
        one = cat.statistics(view).where(F.col("lowest").isNotNull())
        out = one if out is None else out.unionByName(one)
    return out.drop("type")


@register("snapshot_extract", FX.with_views(f"select * from f_snapshot where foto_mes = {MONTH}", **SNAP_VIEW))
def q_snapshot_extract(spark, sf):
    """Store the snapshot one folder per month, read one month back (partition pruning), save it alone."""
    months = scratch_path(spark, "months")
    IO.snapshot_partitions(FX.snapshot(spark, sf), months)
    one = scratch_path(spark, "month")
    IO.sink_columnar(IO.read_month(spark, months, str(MONTH)), one)
    back = IO.scan_columnar(spark, one)
    return back.select("numero_de_cliente", "o_orderkey", F.col("foto_mes").cast("int"), "fecha")


@register("snapshot_partitions", FX.with_views(
    "select numero_de_cliente, o_orderkey, fecha, foto_mes from f_snapshot", **SNAP_VIEW))
def q_snapshot_partitions(spark, sf):
    path = scratch_path(spark, "months")
    IO.snapshot_partitions(FX.snapshot(spark, sf), path)
    back = IO.scan_columnar(spark, path)
    return back.select("numero_de_cliente", "o_orderkey", "fecha", F.col("foto_mes").cast("int"))


@register("export_ranked_probs", FX.with_views("select id as id_cliente, prob as prob_positivo from f_scored",
                                               **scored_views()))
def q_export_ranked(spark, sf):
    scores = FX.scored(spark, sf).select(F.col("id").alias("id_cliente"), F.col("prob").alias("prob_positivo"))
    path = scratch_path(spark, "ranked")
    IO.export_ranked_probs(scores, path)
    return spark.read.option("sep", "\t").option("header", True).option("lineSep", "\r\n").schema(
        "id_cliente bigint, prob_positivo double").csv(path)


@register("export_target_ids", FX.with_views("select id as id_cliente from f_scored where prob > 0.025::double",
                                             **scored_views()))
def q_export_ids(spark, sf):
    scores = FX.scored(spark, sf).select(F.col("id").alias("id_cliente"), F.col("prob").alias("prob_positivo"))
    path = scratch_path(spark, "ids")
    IO.export_target_ids(scores, path, 0.025)
    return spark.read.option("header", False).option("lineSep", "\r\n").schema("id_cliente bigint").csv(path)


@register("ingest_snapshots", FX.with_views(
    f"""select numero_de_cliente, o_orderkey, foto_mes, cast({_DAYS_SQL.replace('fecha', 'Master_fechaalta')} as integer)
        as Master_fechaalta from (select numero_de_cliente, o_orderkey, foto_mes, fecha as Master_fechaalta
        from f_snapshot) s""", **SNAP_VIEW))
def q_ingest(spark, sf):
    """The whole ingest job: TSV snapshot -> raw month copy -> day offsets -> month partitions."""
    snap = FX.snapshot(spark, sf).withColumnRenamed("fecha", "Master_fechaalta")
    src = scratch_path(spark, "snapshot-tsv")
    IO.sink_delimited(snap, src)
    paths = IO.ingest_snapshots(spark, src, scratch_path(spark, "ingest"), [MONTH], schema=snap.schema)
    months = IO.scan_columnar(spark, paths["months"])
    return months.select("numero_de_cliente", "o_orderkey", F.col("foto_mes").cast("int"), "Master_fechaalta")


_UPSERT_SQL = f"""select numero_de_cliente, o_orderkey, foto_mes,
    cast({_DAYS_SQL.replace('fecha', 'Master_fechaalta')} as integer) as Master_fechaalta
    from (select numero_de_cliente, o_orderkey, foto_mes, fecha as Master_fechaalta from f_snapshot
          where foto_mes <> {MONTH} or o_orderkey % 2 = 0) s"""


@register("upsert_snapshots", FX.with_views(_UPSERT_SQL, **SNAP_VIEW))
def q_upsert(spark, sf):
    """The whole snapshot is ingested, then a second delivery of one month (its even orders) replaces that month only."""
    snap = FX.snapshot(spark, sf).withColumnRenamed("fecha", "Master_fechaalta")
    out = scratch_path(spark, "ingest")
    for rows in (snap, snap.where((F.col("foto_mes") == MONTH) & (F.col("o_orderkey") % 2 == 0))):
        src = scratch_path(spark, "snapshot-tsv")
        IO.sink_delimited(rows, src)
        paths = IO.upsert_snapshots(spark, src, out, schema=snap.schema)
    months = IO.scan_columnar(spark, paths["months"])
    return months.select("numero_de_cliente", "o_orderkey", F.col("foto_mes").cast("int"), "Master_fechaalta")


@register("quarantine_rows", "select c_custkey, c_name, c_acctbal::double as c_acctbal, false as quarantined from customer "
          "where c_nationkey <> 3 union all select null, c_name, null, true from customer where c_nationkey = 3")
def q_quarantine(spark, sf):
    """Customers as text, those of one nation with a word in a number's place: they go to the quarantine, with their line."""
    src = FX.table(spark, sf, "customer").select(
        F.when(F.col("c_nationkey") == 3, F.lit("unknown")).otherwise(F.col("c_custkey").cast("string")).alias("c_custkey"),
        "c_name", F.col("c_acctbal").cast("double").alias("c_acctbal"))
    path = scratch_path(spark, "tsv")
    IO.sink_delimited(src, path)
    got = IO.parse_delimited(spark, path, scratch_path(spark, "parsed"), "c_custkey bigint, c_name string, c_acctbal double")
    lost = got.quarantine.select(F.lit(None).cast("bigint").alias("c_custkey"), F.split("raw_line", "\t")[1].alias("c_name"),
                                 F.lit(None).cast("double").alias("c_acctbal"), F.lit(True).alias("quarantined"))
    return got.rows.withColumn("quarantined", F.lit(False)).unionByName(lost)
