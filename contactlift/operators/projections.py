"""Column-level operators: labels, pattern selection, score blends, relative scores, unnesting."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlift.functions.rowwise import columns_like, present


def label_from_class(df: DataFrame, class_col: str = "clase", label: str = "clase01", positive: str = "SI") -> DataFrame:
    """Add the 0/1 label (``class == 'SI'``) unless present, then drop the class column."""
    if label not in df.columns:
        df = df.withColumn(label, F.when(F.col(class_col) == F.lit(positive), F.lit(1)).otherwise(F.lit(0)))
    return df.drop(class_col)


def select_by_pattern(df: DataFrame, drop: Sequence[str] = (), drop_pattern: str | None = None) -> DataFrame:
    """Drop named columns and every column matching a case-insensitive regex."""
    names = set(drop)
    if drop_pattern:
        names |= set(columns_like(df.columns, drop_pattern))
    return df.select(*[c for c in df.columns if c not in names])


def feature_columns(df: DataFrame, id_col: str = "id_cliente", label: str = "clase01",
                    class_prefix: str = "clase") -> list[str]:
    """Training features: every column except the id, the label and anything starting with ``clase``."""
    return [c for c in df.columns if c not in (id_col, label) and not c.lower().startswith(class_prefix.lower())]


def label_and_id_columns(df: DataFrame, id_col: str = "id_cliente", label: str = "clase01") -> DataFrame:
    return df.select(id_col, label)


def blend_scores(left: DataFrame, right: DataFrame, id_col: str = "id", left_prob: str = "prob",
                 right_prob: str = "prob", weight: float = 0.7, right_weight: float | None = None,
                 name: str = "prob") -> DataFrame:
    """``weight * left + right_weight * right`` per id (joined on id, never by row position).

    ``right_weight`` defaults to ``1 - weight``; pass 0.3 to get the literal 0.3 rather than
    0.30000000000000004.
    """
    rw_ = (1.0 - weight) if right_weight is None else right_weight
    r = right.select(F.col(id_col), F.col(right_prob).alias("__p_right"))
    j = left.select(F.col(id_col), F.col(left_prob).alias("__p_left")).join(r, id_col, "inner")
    return j.select(id_col, (F.lit(weight) * F.col("__p_left") + F.lit(rw_) * F.col("__p_right")).alias(name))


def relative_to_baseline(df: DataFrame, baseline: str, pattern: str, keep: Sequence[str] = ()) -> DataFrame:
    """Every column matching ``pattern`` as a percentage of the ``baseline`` column."""
    cols = columns_like(df.columns, pattern)
    return df.select(*keep, *[(F.col(c) / F.nullif(F.col(baseline), F.lit(0)) * F.lit(100.0)).alias(c) for c in cols])


def explode_results(df: DataFrame, list_col: str) -> DataFrame:
    """Unnest an ``array<struct>`` result column into rows (one per element), keeping the other columns."""
    others = [c for c in df.columns if c != list_col]
    return df.select(*others, F.inline(F.col(list_col)))


def filter_cutoff_inclusive(df: DataFrame, cutoff: float, prob: str = "prob") -> DataFrame:
    """Rows with ``prob >= cutoff``; a missing or NaN probability does not pass."""
    return df.where(present(prob) >= F.lit(cutoff))


def filter_cutoff_strict(df: DataFrame, cutoff: float, prob: str = "prob") -> DataFrame:
    """Rows with ``prob > cutoff``; a missing or NaN probability does not pass."""
    return df.where(present(prob) > F.lit(cutoff))


def head_n(df: DataFrame, n: int, order: Sequence) -> DataFrame:
    """First ``n`` rows after a sort: planned as a top-n (TakeOrderedAndProject), not a full sort."""
    return df.orderBy(*order).limit(n)


def tail_n(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    """Last ``n`` rows of an ascending sort on ``order``: a top-n on the reversed order."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n)


def attach_scores_by_id(left: DataFrame, right: DataFrame, id_col: str = "id", prob: str = "prob", names: Sequence[str] = ("prob_a", "prob_b"),
                        keep: Sequence[str] = ()) -> DataFrame:
    """(id, one score of each table, kept columns of the left one) for the ids that both have; NULL ids match nothing."""
    return left.select(id_col, F.col(prob).alias(names[0]), *keep).join(right.select(id_col, F.col(prob).alias(names[1])), id_col)


def scatter_by_fold(long: DataFrame, models: Sequence[int], id_col: str = "id", prob: str = "prob", model: str = "model_id",
                    prefix: str = "modelito_") -> DataFrame:
    """One row per id with one score column per model, from long (model, id, score) rows; the models are a given list, so no
    pass over the data looks for them."""
    wide = long.groupBy(id_col).pivot(model, list(models)).agg(F.max(prob))
    return wide.withColumnsRenamed({str(m): f"{prefix}{m}" for m in models})


def sort_by_prob_desc(df: DataFrame, id_col: str = "id", prob: str = "prob") -> DataFrame:
    """Rows by descending score, missing and NaN scores last, ties by id."""
    return df.orderBy(F.desc_nulls_last(present(prob)), F.asc(id_col))
