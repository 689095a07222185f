"""Ranks and thresholds in hash order without sorting: counts by hash prefix, refined where they are needed.

The order inside a stratum is ``(hash, id)`` with a hex hash. Rows are counted by ``(stratum, first digits of the hash)``:
map-side partial sums, so a stratum with a third of the rows shuffles no more than ``16 ** STEP`` counts a task.

* ``quota_bounds`` finds the row at a given rank of every stratum. Running sums of the counts name the one prefix that
  holds it; only that prefix is counted again, ``STEP`` digits deeper, until few enough rows share it to be ranked. The
  input is read ``1 + log(n / FEW) / log(16 ** STEP)`` times and no row is sorted or checkpointed.
* ``hash_ranks`` ranks every row where it stands: the running sum of the counts before a row's prefix, plus its rank among
  the rows of the prefix. One exchange of the rows, by ``(stratum, prefix)``; prefixes are lengthened until none holds
  more than ``SHARED`` hashes, so the counts stay a small table (65,536 a stratum at 10 ** 11 rows).

Hashes are uniform, so prefixes are even, whatever the ids. Rows with one id have one hash and one rank.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contactlift.session import sized

HASH = "__h"
# Hex digits that one pass of counting adds at most, digits of a hash, rows of a stratum that are ranked to find a bound,
# and distinct hashes that one window partition ranks (a rank is a running frame: the partition is streamed, not held).
STEP = 3
DIGITS = 32
FEW = 1 << 16
SHARED = 1 << 22


def attach(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` treating NULL as a value (dplyr groups NA together)."""
    if not keys:
        raise ValueError("a keyless attach is a cross join; use a scalar instead")
    r = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    j = left.join(r, [left[k].eqNullSafe(r[f"__r_{k}"]) for k in keys], how)
    return j.drop(*[f"__r_{k}" for k in keys])


def _prefix(digits: int) -> Column:
    return F.substring(HASH, 1, digits)


def _before(strata: Sequence[str], order: str) -> Window:
    return Window.partitionBy(*strata).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)


def stratum_sizes(narrow: DataFrame, strata: Sequence[str], name: str = "__n") -> DataFrame:
    return narrow.groupBy(*strata).agg(F.count(F.lit(1)).alias(name))


def quota_bounds(narrow: DataFrame, strata: Sequence[str], id_col: str, quota: Column, few: int = FEW) -> DataFrame:
    """Per stratum the (hash, id) of its row number ``quota`` in hash order, as ``__bh`` and ``__bid``.

    ``narrow`` has the strata, the id and ``__h``; ``quota`` is an expression of the stratum's size ``__n``. Strata whose
    quota is 0 have no row in the result. With repeated ids the bound is the id that the quota falls into.
    """
    strata = list(strata)
    digits = STEP
    counts = narrow.groupBy(*strata, _prefix(digits).alias("__p")).agg(F.count(F.lit(1)).alias("__c"))
    whole = Window.partitionBy(*strata)
    held = (counts.withColumns({"__past": F.coalesce(F.sum("__c").over(_before(strata, "__p")), F.lit(0)),
                                "__n": F.sum("__c").over(whole)})
            .withColumn("__left", quota - F.col("__past")))
    while True:
        # the prefix that holds the quota: one row per stratum
        held = sized(held.where((F.col("__left") > 0) & (F.col("__left") <= F.col("__c"))).select(*strata, "__p", "__c", "__left"))
        if digits >= DIGITS or (held.agg(F.max("__c")).first()[0] or 0) <= few:
            break
        inside = attach(narrow.withColumn("__p", _prefix(digits)), held.drop("__c"), [*strata, "__p"])
        digits = min(DIGITS, digits + STEP)
        counts = inside.groupBy(*strata, _prefix(digits).alias("__p")).agg(
            F.count(F.lit(1)).alias("__c"), F.first("__left").alias("__left"))
        held = counts.withColumn("__left", F.col("__left") - F.coalesce(F.sum("__c").over(_before(strata, "__p")), F.lit(0)))
    # at most `few` rows a stratum, or rows that share one hash: rank their distinct ids by running counts
    inside = attach(narrow.withColumn("__p", _prefix(digits)), held.select(*strata, "__p", "__left"), [*strata, "__p"])
    ids = inside.groupBy(*strata, HASH, id_col).agg(F.count(F.lit(1)).alias("__c"), F.first("__left").alias("__left"))
    order = [F.asc(HASH), F.asc_nulls_first(id_col)]
    upto = F.sum("__c").over(Window.partitionBy(*strata).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    found = ids.withColumn("__u", upto).where((F.col("__u") >= F.col("__left")) & (F.col("__u") - F.col("__c") < F.col("__left")))
    return found.select(*strata, F.col(HASH).alias("__bh"), F.col(id_col).alias("__bid"))


def hash_ranks(df: DataFrame, strata: Sequence[str], id_col: str, name: str = "__rn", shared: int = SHARED) -> DataFrame:
    """``df`` (with ``__h``) and the 1-based rank of every row in its stratum, in ``(hash, id)`` order.

    Equal ids of a stratum share the rank of the first of them, so the result depends on the data alone. No join by id.
    """
    strata = list(strata)
    narrow = df.select(*strata, HASH)
    above, digits, levels = 0, STEP, []
    while True:
        counts = narrow.groupBy(*strata, _prefix(digits).alias("__p")).agg(
            F.count(F.lit(1)).alias("__c"), F.approx_count_distinct(HASH).alias("__d"))
        # the rows before a prefix, inside the prefix of the level above
        inside = Window.partitionBy(*strata, F.substring("__p", 1, above)).orderBy("__p").rowsBetween(
            Window.unboundedPreceding, -1)
        counts = sized(counts.withColumn("__off", F.coalesce(F.sum("__c").over(inside), F.lit(0))))
        levels.append((digits, counts.select(*strata, "__p", "__off")))
        most = counts.agg(F.max("__d")).first()[0] or 0
        if digits == DIGITS or most <= shared:
            break
        above, digits = digits, min(DIGITS, digits + min(STEP, math.ceil(math.log(most / shared, 16))))
    out = df.withColumn(name, F.lit(0).cast("bigint"))
    for n, offsets in levels:  # tables of at most 16 ** n counts a stratum: broadcast by their bytes, or joined
        out = attach(out.withColumn("__p", _prefix(n)), offsets, [*strata, "__p"]).withColumn(
            name, F.col(name) + F.col("__off")).drop("__off", "__p")
    out = out.withColumn("__p", _prefix(digits))
    place = F.rank().over(Window.partitionBy(*strata, "__p").orderBy(F.asc(HASH), F.asc_nulls_first(id_col)))
    return out.withColumn(name, F.col(name) + place).drop("__p")
