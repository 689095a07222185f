"""Row-wise Column functions with the reference's missing-value and division rules.

All of them are built-in Spark expressions, so they stay inside whole-stage codegen.

* max / min / sum / mean skip missing values, and NaN counts as missing.
* A sum over only missing values is 0; max, min and mean over only missing values are NULL.
* A ratio is IEEE: x/0 is +Inf or -Inf by the sign of x, 0/0 and anything with NaN is NaN,
  anything with NULL is NULL. Spark's ANSI mode would raise on x/0, so the zero case is guarded.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing_to_null(c: ColumnLike) -> Column:
    """Cast to double and turn NaN into NULL (NaN is missing under ``na.rm``)."""
    x = _col(c).cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def row_max_narm(*cols: ColumnLike) -> Column:
    """Row maximum skipping missing values; NULL when all are missing."""
    return F.greatest(*[missing_to_null(c) for c in cols])


def row_min_narm(*cols: ColumnLike) -> Column:
    """Row minimum skipping missing values; NULL when all are missing."""
    return F.least(*[missing_to_null(c) for c in cols])


def row_sum_narm(*cols: ColumnLike) -> Column:
    """Row sum skipping missing values; 0 when all are missing. Added left to right."""
    terms = [F.coalesce(missing_to_null(c), F.lit(0.0)) for c in cols]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


def row_mean_narm(*cols: ColumnLike) -> Column:
    """Row mean skipping missing values; NULL when all are missing."""
    present = [F.when(missing_to_null(c).isNotNull(), F.lit(1)).otherwise(F.lit(0)) for c in cols]
    n = present[0]
    for p in present[1:]:
        n = n + p
    return F.when(n > 0, row_sum_narm(*cols) / n)


def safe_ratio(num: ColumnLike, den: ColumnLike, mode: str = "ieee") -> Column:
    """Division of two columns without ANSI errors.

    ``mode='ieee'`` keeps the reference's IEEE results (Inf, -Inf, NaN);
    ``mode='null'`` returns NULL for a zero denominator instead.
    """
    n = _col(num).cast("double")
    d = _col(den).cast("double")
    if mode == "null":
        return F.when(d != 0, n / d)
    if mode != "ieee":
        raise ValueError(f"unknown mode {mode!r}")
    # For d = +-0, pow(d, -1) is +-Inf (no ANSI check on pow), and x * (+-Inf) is exactly the IEEE
    # x / (+-0): +-Inf by the signs, NaN for 0 and NaN, NULL for NULL. A NULL or NaN denominator
    # falls to the plain division (NULL or NaN).
    return F.when(d == 0, n * F.pow(d, F.lit(-1.0))).otherwise(n / d)


def finite_or_null(c: ColumnLike) -> Column:
    """The value when finite, else NULL (for outputs compared by value hash)."""
    x = _col(c)
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def ieee_class(c: ColumnLike) -> Column:
    """0 finite, 1 +Inf, 2 -Inf, 3 NaN, NULL when missing: the flag that goes with ``finite_or_null``."""
    x = _col(c)
    return (
        F.when(x.isNull(), F.lit(None).cast("int"))
        .when(F.isnan(x), F.lit(3))
        .when(x == F.lit(float("inf")), F.lit(1))
        .when(x == F.lit(float("-inf")), F.lit(2))
        .otherwise(F.lit(0))
    )


def days_to_snapshot_end(month: ColumnLike, date: ColumnLike) -> Column:
    """Days from a ``yyyymmdd`` date to the first day of the month after ``yyyymm``.

    Future dates give negative numbers; an unparseable date or month gives NULL.
    """
    month_start = F.try_to_date(F.concat(_col(month).cast("string"), F.lit("01")), "yyyyMMdd")
    d = F.try_to_date(_col(date).cast("string"), "yyyyMMdd")
    return F.datediff(F.add_months(month_start, 1), d)


def present(score: Column | str) -> Column:
    """A score as a double, NaN as missing: missing scores pass no filter and rank last."""
    score = F.col(score) if isinstance(score, str) else score
    return F.nanvl(score.cast("double"), F.lit(None).cast("double"))


def hash_key(seed: int | Column, *parts: ColumnLike) -> Column:
    """md5 hex of ``seed:part1:part2...``; the ordering key of every repeatable draw."""
    pieces: list[Column] = [F.lit(str(seed)) if not isinstance(seed, Column) else seed.cast("string")]
    for p in parts:
        pieces += [F.lit(":"), F.coalesce(_col(p).cast("string"), F.lit(""))]
    return F.md5(F.concat(*pieces))


def hash_uniform(seed: int | Column, *parts: ColumnLike) -> Column:
    """Repeatable uniform number in [0, 1) from the first 32 bits of ``hash_key``.

    Unlike ``rand()`` it does not change when the input is reshuffled or a task is retried.
    """
    h = hash_key(seed, *parts)
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint") / F.lit(4294967296.0)


def breakeven_cutoff(gain: float = 19500.0, cost: float = 500.0, undersampling: float = 1.0) -> float:
    """Probability cutoff where a contact breaks even once negatives were kept at rate ``undersampling``."""
    c = cost / undersampling
    return c / (gain + c)


def normalise_target(c: ColumnLike) -> Column:
    """Label 1 or 'SI' as 1, anything else as 0 (missing stays missing)."""
    x = _col(c).cast("string")
    return F.when(x.isNull(), F.lit(None).cast("int")).when(x.isin("1", "SI", "1.0"), F.lit(1)).otherwise(F.lit(0))


def columns_like(names: Iterable[str], pattern: str) -> list[str]:
    """Names matching a case-insensitive regular expression, in schema order."""
    import re

    rx = re.compile(pattern, re.IGNORECASE)
    return [n for n in names if rx.search(n)]
