"""Running sums and row numbers in a global (or per-stratum) order, distributed.

A bare ``sum(x).over(Window.orderBy(...))`` moves every row into one task, and
``row_number().over(Window.partitionBy(label)...)`` puts a whole class (most of the rows) into
one task. Both are replaced by the same two-level plan:

1. range-partition the rows on ``(strata, order)`` into ordered buckets (their number starts at
   ``spark.sql.shuffle.partitions`` and AQE may merge adjacent small ranges); the range
   partitioner samples the composite key, so heavy ties on the score are split by the unique
   tie-break column and no bucket holds a hot group whole;
2. checkpoint into the shared checkpoint folder, which fixes the bucket of every row (a retried
   task or a lost executor cannot move a row to another bucket);
3. total each value per ``(bucket, stratum)`` -- at most ``B + strata`` rows;
4. exclusive prefix of those totals per stratum, ordered by bucket;
5. an in-bucket window plus the bucket's offset.

``order`` must be a total order (end with a unique key), as ties would make any running sum
depend on the engine's row order.

One plan for every size: there is no small-input path.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactlift.session import reliable_checkpoint, sized

_BUCKET = "__cl_bucket"


def _bucketed(df: DataFrame, partition_by: Sequence[str], order: Sequence[Column], num_buckets: int | None) -> DataFrame:
    keys = [F.asc_nulls_first(c) for c in partition_by] + list(order)
    # without an explicit count AQE may coalesce adjacent ranges (the ranges stay contiguous and
    # ordered), so the bucket count follows the data size; an explicit num_buckets pins it
    ranged = df.repartitionByRange(num_buckets, *keys) if num_buckets else df.repartitionByRange(*keys)
    return reliable_checkpoint(ranged.withColumn(_BUCKET, F.spark_partition_id()))


def running_sums(
    df: DataFrame,
    order: Sequence[Column],
    values: Mapping[str, Column],
    partition_by: Sequence[str] = (),
    num_buckets: int | None = None,
    totals_out: list | None = None,
) -> DataFrame:
    """Add one column per ``values`` entry: its inclusive running sum in ``order`` within ``partition_by``.

    If ``totals_out`` is a list, the per-stratum grand totals (one row per stratum, read from
    the small bucket-totals table) are appended to it.
    """
    partition_by = list(partition_by)
    vcols = {name: f"__cl_v_{i}" for i, name in enumerate(values)}
    staged = df.withColumns({vcols[name]: col for name, col in values.items()})
    ranged = _bucketed(staged, partition_by, order, num_buckets)

    group = [_BUCKET, *partition_by]
    totals = ranged.groupBy(*group).agg(*[F.sum(v).alias(v) for v in vcols.values()])
    w_prev = Window.partitionBy(*partition_by).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    okeys = {k: f"__cl_k_{i}" for i, k in enumerate(group)}
    offsets = totals.select(
        *[F.col(k).alias(okeys[k]) for k in group],
        *[F.coalesce(F.sum(v).over(w_prev), F.lit(0)).alias(f"{v}_off") for v in vcols.values()],
    )
    offsets = sized(offsets)  # at most buckets + strata rows
    if totals_out is not None:
        totals_out.append(totals.groupBy(*partition_by).agg(*[F.sum(v).alias(name) for name, v in vcols.items()]))

    w_in = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # range on the bucket id: one bucket per task (a hash of B ids into B partitions would stack
    # several buckets in some tasks); it also satisfies the window's clustering, so no other exchange
    # one task per bucket: the bucket count is read from the small offsets table
    n_buckets = num_buckets or offsets.select(okeys[_BUCKET]).distinct().count()
    by_bucket = ranged.repartitionByRange(max(1, n_buckets), F.col(_BUCKET))
    local = by_bucket.withColumns({f"{v}_loc": F.sum(v).over(w_in) for v in vcols.values()})
    cond = [local[k].eqNullSafe(offsets[okeys[k]]) for k in group]
    joined = local.join(offsets, cond, "inner")
    out = joined.withColumns({name: F.col(f"{v}_loc") + F.col(f"{v}_off") for name, v in vcols.items()})
    drop = [_BUCKET, *okeys.values()] + [c for v in vcols.values() for c in (v, f"{v}_loc", f"{v}_off")]
    return out.drop(*drop)


def row_numbers(
    df: DataFrame,
    order: Sequence[Column],
    name: str = "rn",
    partition_by: Sequence[str] = (),
    num_buckets: int | None = None,
    totals_out: list | None = None,
) -> DataFrame:
    """``row_number()`` over ``partition_by`` in ``order``, without one task per stratum.

    With ``totals_out`` the stratum sizes (column ``name``) are appended to that list.
    """
    out = running_sums(df, order, {name: F.lit(1).cast("bigint")}, partition_by, num_buckets, totals_out)
    return out
