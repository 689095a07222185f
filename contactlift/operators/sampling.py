"""Exact, repeatable stratified sampling, splits and folds.

``sample_frac`` semantics: each stratum keeps ``round_half_even(n * fraction)`` rows. Rows are
ranked inside their stratum by ``md5("seed:id")`` then id, so the draw is a pure function of
the seed and the data: no global random state, no change when the input is reshuffled or a task
is retried (unlike ``rand()``/``sampleBy``, which are Bernoulli and not exact).

Scale: a sample's threshold comes from counts by hash prefix of a narrow projection
``(strata, id, hash)`` (see ``selection``); the wide rows are then filtered against one boundary
row per stratum, so selecting a sample sorts nothing and never shuffles the wide table. Folds rank
the rows where they stand.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlift.functions.rowwise import hash_key, hash_uniform
from contactlift.operators.ranking import row_numbers
from contactlift.operators.selection import HASH, attach, hash_ranks, quota_bounds
from contactlift.session import sized

# The reference's master seed (used when the split gets seed -1).
MASTER_SEED = 123457


def resolve_seed(seed: int | None) -> int:
    """-1 means the master seed; any other number is used as given."""
    if seed is None or seed == -1:
        return MASTER_SEED
    return int(seed)


def _seed_col(seed: int | str | Column) -> Column | int:
    if isinstance(seed, str):
        return F.col(seed)
    return seed


def _ranked(df: DataFrame, strata: Sequence[str], id_col: str, seed, num_buckets: int | None) -> DataFrame:
    """Narrow table (strata, id, __h, rn, __n) with the in-stratum rank and the stratum size."""
    narrow = df.select(*strata, id_col).withColumn("__h", hash_key(_seed_col(seed), F.col(id_col)))
    sizes: list[DataFrame] = []
    ranked = row_numbers(narrow, [F.asc("__h"), F.asc(id_col)], "rn", partition_by=strata, num_buckets=num_buckets,
                         totals_out=sizes)
    # stratum sizes come from the bucket totals of the checkpointed narrow table
    n = sizes[0].withColumnRenamed("rn", "__n")
    return attach(ranked, sized(n), strata)


def stratum_quota(n: Column, fraction: float) -> Column:
    return F.bround(n.cast("double") * F.lit(float(fraction)), 0).cast("bigint")


def stratified_sample(df: DataFrame, fraction: float, strata: Sequence[str] = (), seed: int | str = MASTER_SEED,
                      id_col: str = "id_cliente", replace: bool = False, num_buckets: int | None = None) -> DataFrame:
    """Exactly ``round_half_even(n * fraction)`` rows per stratum (no strata: of the whole table).

    ``seed`` is a number, or the name of a column holding one (one sample per seed value; put
    that column in ``strata`` as well).
    """
    strata = list(strata)
    if fraction < 0:
        raise ValueError("fraction must be >= 0")
    if replace:
        return sample_with_replacement(df, fraction, strata, seed, id_col, num_buckets)
    if fraction > 1:
        raise ValueError("fraction > 1 needs replace=True (a stratum cannot give more rows than it has)")
    if not strata:
        df = df.withColumn("__all", F.lit(0))
        strata = ["__all"]
    return mark_sample(df, fraction, strata, seed, id_col).where(F.col("__in_sample")).drop("__in_sample")


def mark_sample(df: DataFrame, fraction: float, strata: Sequence[str] = (), seed: int | str = MASTER_SEED,
                id_col: str = "id_cliente", name: str = "__in_sample") -> DataFrame:
    """Every row of ``df`` with a boolean ``name``: is it in the exact stratified sample?

    Counts by hash prefix of the narrow (strata, id, hash) projection give each stratum's last kept
    row, the boundary; rows are compared with it after a join to that small table (one row per
    stratum), so train and test come from one plan without shuffling the wide rows.
    """
    strata = list(strata)
    if not 0 <= fraction <= 1:
        raise ValueError("a sample without replacement needs 0 <= fraction <= 1")
    work = df
    if not strata:
        work = df.withColumn("__all", F.lit(0))
        strata = ["__all"]
    keyed = work.withColumn(HASH, hash_key(_seed_col(seed), F.col(id_col)))
    bounds = quota_bounds(keyed.select(*strata, id_col, HASH), strata, id_col, stratum_quota(F.col("__n"), fraction))
    out = attach(keyed, sized(bounds), strata, how="left")
    inside = (F.col("__bh").isNotNull()
              & ((F.col("__h") < F.col("__bh")) | ((F.col("__h") == F.col("__bh")) & (F.col(id_col) <= F.col("__bid")))))
    return out.withColumn(name, inside).drop("__h", "__bh", "__bid", "__all")


def sample_with_replacement(df: DataFrame, fraction: float, strata: Sequence[str] = (), seed: int | str = MASTER_SEED,
                            id_col: str = "id_cliente", num_buckets: int | None = None) -> DataFrame:
    """``round_half_even(n * fraction)`` draws with replacement per stratum.

    Draw ``i`` of a stratum picks the row at position ``1 + md5(seed:stratum:i) mod n`` of the
    stratum's ranking. Draws are generated by the rows themselves (row ``rn`` makes draws
    ``rn, rn + n, ...``), so no task ever produces a whole stratum's draws.
    """
    strata = list(strata)
    if not strata:
        df = df.withColumn("__all", F.lit(0))
        strata = ["__all"]
    ranked = _ranked(df, strata, id_col, seed, num_buckets).select(*strata, id_col, "rn", "__n")
    copies = max(1, math.ceil(float(fraction)))
    k = stratum_quota(F.col("__n"), fraction)
    draws = (ranked.select(*strata, "rn", "__n", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))).alias("__j"))
             .withColumn("__i", F.col("rn") + F.col("__j") * F.col("__n"))
             .where(F.col("__i") <= k))
    stratum_key = F.concat_ws(":", *[F.coalesce(F.col(s).cast("string"), F.lit("")) for s in strata])
    pick = F.conv(F.substring(hash_key(_seed_col(seed), stratum_key, F.col("__i")), 1, 15), 16, 10).cast("bigint")
    draws = draws.select(*strata, "__i", (F.lit(1) + pick % F.col("__n")).alias("__pos"))
    picked = attach(draws, ranked.select(*strata, F.col("rn").alias("__pos"), id_col), [*strata, "__pos"])
    out = picked.select(id_col, "__i").join(df, id_col, "inner")
    return out.drop("__i", "__all")


def train_test_split(df: DataFrame, fraction: float = 0.7, seed: int | None = -1, strata: Sequence[str] = ("clase",),
                     id_col: str = "id_cliente",
                     ids_unique: bool | None = None) -> tuple[DataFrame, DataFrame]:
    """Stratified train sample and the rest.

    The rest is the anti-join by id, so duplicate ids leave together. When the ids are unique
    that equals the complement of the sample, and both sides are filters of one marked plan: no
    wide shuffle for the anti-join. ``ids_unique``: None checks (on the narrow id column), True
    trusts the caller, False always anti-joins.
    """
    s = resolve_seed(seed)
    marked = mark_sample(df, fraction, strata, s, id_col)
    train = marked.where(F.col("__in_sample")).drop("__in_sample")
    unique = ids_unique if ids_unique is not None else not has_duplicate_ids(df, id_col)
    if unique:
        return train, marked.where(~F.col("__in_sample")).drop("__in_sample")
    return train, anti_join_by_id(df, train, id_col)


def has_duplicate_ids(df: DataFrame, id_col: str = "id_cliente") -> bool:
    """True if an id occurs twice (or is NULL); reads and shuffles only the id column."""
    ids = df.select(id_col)
    dup = ids.groupBy(id_col).count().where((F.col("count") > 1) | F.col(id_col).isNull())
    return len(dup.limit(1).collect()) > 0


def anti_join_by_id(full: DataFrame, taken: DataFrame, id_col: str = "id_cliente") -> DataFrame:
    """Rows of ``full`` whose id is not in ``taken``; NULL ids never match."""
    return full.join(taken.select(id_col), id_col, "left_anti")


def stratified_folds(df: DataFrame, k: int = 5, seed: int = MASTER_SEED, strata: Sequence[str] = ("clase01",),
                     id_col: str = "id_cliente", name: str = "fold") -> DataFrame:
    """Fold ``(rank_in_stratum - 1) % k``: folds split each class evenly (sizes differ by at most one).

    Rows are ranked where they stand, one exchange by stratum and hash prefix; there is no join by id. Rows that share an
    id (and NULL ids among themselves) go to one fold.
    """
    if name in df.columns:
        df = df.drop(name)
    ranked = hash_ranks(df.withColumn(HASH, hash_key(_seed_col(seed), F.col(id_col))), list(strata), id_col)
    fold = ((F.col("__rn") - 1) % F.lit(k)).cast("int")
    return ranked.withColumn(name, fold).drop("__rn", HASH)


def uniform_sample_column(df: DataFrame, seed: int = MASTER_SEED, id_col: str = "id_cliente",
                          name: str = "sample") -> DataFrame:
    """Add a repeatable U[0,1) column keyed by (seed, id)."""
    return df.withColumn(name, hash_uniform(seed, F.col(id_col)))


def undersample_majority(df: DataFrame, rate: float = 0.2, fold: int | None = None, fold_col: str = "fold",
                         label: str = "clase01", sample_col: str = "sample") -> DataFrame:
    """Rows outside ``fold`` that are positive or have ``sample < rate``."""
    keep = (F.col(sample_col) < F.lit(rate)) | (F.col(label) == 1)
    if fold is not None:
        keep = (F.col(fold_col) != F.lit(fold)) & keep
    return df.where(keep)


def fold_complement(df: DataFrame, fold: int, fold_col: str = "fold") -> DataFrame:
    return df.where(F.col(fold_col) != F.lit(fold))


def cross_seed_rows(df: DataFrame, seeds: Sequence[int], name: str = "seed") -> DataFrame:
    """Every row once per seed (a generator over a literal list, no join)."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
