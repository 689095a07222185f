"""Mixing sources to target weights by subset-sum budget fitting.

Every source gets a word budget (its target). Whole repeats of the source fill as much of it as fits; the rest is
fitted by choosing documents whose sizes add up to it: documents are counted by exact size, the same share is taken all
along the sizes, and a bounded-knapsack table over documents to add and to drop settles what is left. Which documents of a size are taken is decided by a seeded hash.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from contactlift.llm.store import written

WORD = r"[^\x20\x09-\x0D]+"
# Documents of one source and size are ranked in bins of about this many, so no task ranks a whole hot group.
BIN_ROWS = 5000
TABLE = 1 << 16


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` with ``number``, 0-based in the given order, without sorting everything in one task."""
    rows = written(df.orderBy(*order).select("*", F.spark_partition_id().alias("_p"),
                                             F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("_i")),
                   "numbered")
    at, base = 0, {}
    for p, n in sorted((r[0], r[1]) for r in rows.groupBy("_p").count().collect()):  # one row per partition
        base[p], at = at, at + n
    starts = df.sparkSession.createDataFrame(sorted(base.items()), "_p int, _start long")
    return (rows.join(starts, "_p").select("*", (F.col("_start") + F.col("_i")).alias("number"))
            .drop("_p", "_i", "_start"))


def targets(sources: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """Add ``target`` to (source, source_size): ``share`` of all words split by weight (the weights repeat over the
    sources in code-point order, null last), no target above ``most`` times its source's size, the excess shared
    again by weight among the others until none is above. When all are at their limit the excess is lost."""
    order = [F.col("source").isNull(), F.col("source")]
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    base = written(numbered(sources, *order).select("source", "source_size", w.alias("w"),
                                                    (most * F.col("source_size")).alias("cap")), "sources")
    total = share * float(base.agg(F.sum("source_size")).first()[0] or 0)
    level, full = 0.0, F.lit(False)  # a source is full when its cap is below level * w
    while True:
        r = base.agg(F.sum(F.when(full, F.col("cap"))).alias("c"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        if not r or not r["w"]:
            break
        level = (total - (r["c"] or 0.0)) / r["w"]
        now = full | (F.col("w") * level > F.col("cap"))
        if base.where(now & ~full).isEmpty():
            break
        full = F.col("w") * level > F.col("cap")  # the level only rises, so earlier ones stay full
    return base.select("source", "source_size", F.when(full, F.col("cap")).otherwise(F.col("w") * level).alias("target"))


def fit_counts(sizes: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each size to take so that their words come as near to ``budget`` as can be found.

    One rule at every budget: the same share of the documents is taken all along the sizes (in order of size, rounded as a
    running sum, so classes of sizes of any count keep their share and the words miss the budget by one document at most).
    What is missing or too much is settled by documents to add or to drop: the largest that fit, one of a size (more of it
    while more than ``TABLE`` words are left), then a bounded-knapsack table of the sums within ``2 * TABLE`` words, from
    small sizes on, until the budget is met; else the nearest sum is taken. If all sums lie in the table, it is the nearest
    of all.
    """
    take = np.zeros(len(sizes), np.int64)
    total = int((sizes * counts).sum())
    if not len(sizes) or budget <= 0 or total == 0:
        return take
    if budget >= total:
        return counts.copy()
    order = np.argsort(sizes, kind="stable")
    upto = np.cumsum(counts[order]).astype(object) * budget // total
    take[order] = np.diff(upto, prepend=0).astype(np.int64)
    rest = budget - int((take * sizes).sum())
    for i in order[::-1]:
        size = int(sizes[i])
        if 0 < size <= abs(rest):  # one document of a size, so that no class of sizes pays for the rest
            most = abs(rest) // size if abs(rest) > TABLE else 1
            n = min(int(counts[i] - take[i] if rest > 0 else take[i]), most) * (1 if rest > 0 else -1)
            take[i] += n
            rest -= n * size
    reach = 2 * TABLE
    rest = max(-reach, min(reach, rest))  # out of reach only if no small enough documents are left
    via = np.full(2 * reach + 1, -1, np.int32)  # the piece that first reached a sum; the sum 0 is at ``reach``
    seen = np.zeros(2 * reach + 1, bool)
    seen[reach] = True
    pieces = []
    for i in order:
        size = int(sizes[i])
        for sign, left in ((1, int(counts[i] - take[i])), (-1, int(take[i]))):
            left = min(left, reach // size) if size else 0
            n = 1
            while left > 0 and not seen[reach + rest]:
                n = min(n, left)
                step = n * size
                new = np.zeros_like(seen)
                if sign > 0:
                    new[step:] = seen[:-step]
                else:
                    new[:-step] = seen[step:]
                new &= ~seen
                via[new] = len(pieces)
                seen |= new
                pieces.append((i, sign * n, sign * step))
                left -= n
                n *= 2
    reached = np.flatnonzero(seen)
    at = int(reached[np.argmin(np.abs(reached - reach - rest))])
    while at != reach:
        i, n, step = pieces[via[at]]
        take[i] += n
        at -= step
    return take


def mix_sources(docs: DataFrame, weights: list[float] = (5, 2, 1), share: float = 1.0, most: float = 3,
                seed: int = 7, id_col: str = "doc_id", source: str = "source", size: Column | None = None) -> DataFrame:
    """One row per row of ``docs``: (id_col, size, source_size, target, taken, source, copies).

    ``taken`` = ``size * copies`` words. A null or word-free text has size 0 and takes nothing. A null source is a
    source of its own, ordered last. Rows with equal ids are separate documents, chosen by the same hash in any
    order (their sizes are equal, so the sums agree). A null id is allowed. Extra columns are ignored; an empty
    table gives an empty result. Reruns agree: the choice depends on (seed, id, source, size) alone.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(source).cast("string").alias("source"),
                         (n_words() if size is None else size).alias("size"))
    narrow = written(narrow.withColumn("u", F.xxhash64(F.lit(seed), "id", "source", "size")), "sizes")
    hist = written(narrow.groupBy("source", "size").agg(F.count("*").alias("n")), "counts")
    goal = written(targets(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")),
                           list(weights), share, most), "targets")

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        s = g["size"].to_numpy(np.int64)
        n = g["n"].to_numpy(np.int64)
        total, target = int(g["source_size"].iloc[0]), float(g["target"].iloc[0])
        whole = min(int(target // total), int(most)) if total else 0
        ok = s > 0
        extra = np.zeros(len(s), np.int64)
        if whole < most:
            extra[ok] = fit_counts(s[ok], n[ok], round(target - whole * total))
        return pd.DataFrame({"source": g["source"], "size": s, "n": n, "source_size": total, "target": target,
                             "whole": whole, "extra": extra})

    sized = hist.join(goal, hist["source"].eqNullSafe(goal["source"])).select(
        hist["source"], "size", "n", "source_size", "target")
    plan = written(sized.groupBy("source").applyInPandas(
        fit, "source string, size long, n long, source_size long, target double, whole long, extra long"), "plan")

    p = plan.select(F.col("source").alias("s"), F.col("size").alias("z"), "n", "source_size", "target", "whole", "extra")
    bins = F.greatest(F.lit(1), F.ceil(F.col("n") / BIN_ROWS))
    rows = narrow.join(p, (F.col("size") == F.col("z")) & F.col("source").eqNullSafe(F.col("s"))).select(
        "id", "source", "size", "u", "source_size", "target", "whole", "extra", "n",
        F.floor((F.col("u").cast("double") / 2.0**64 + 0.5) * bins).alias("bin"))
    # only groups that are taken in part need an order, and in them only the bin in which the quota ends
    part = (F.col("extra") > 0) & (F.col("extra") < F.col("n"))
    count = (rows.where(part).groupBy("source", "size", "bin").agg(F.count("*").alias("m"), F.max("extra").alias("q")))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("source", "size").orderBy("bin")
                                        .rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    quota = count.select(F.col("source").alias("s"), F.col("size").alias("z"), F.col("bin").alias("b"), "m",
                         F.least(F.greatest(F.col("q") - before, F.lit(0)), F.col("m")).alias("take"))
    rows = rows.join(quota, (F.col("size") == F.col("z")) & (F.col("bin") == F.col("b"))
                     & F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "z", "b")
    edge = part & (F.col("take") > 0) & (F.col("take") < F.col("m"))
    key = F.when(edge, F.col("bin")).otherwise(-1 - F.pmod("u", F.lit(1 << 20)))  # spread rows that need no rank
    rank = F.row_number().over(Window.partitionBy("source", "size", key).orderBy("u", "id"))
    more = (F.when(F.col("extra") >= F.col("n"), 1).when(~part, 0).when(~edge, (F.col("take") > 0).cast("int"))
            .otherwise((rank <= F.col("take")).cast("int")))
    copies = F.when(F.col("size") > 0, F.col("whole") + more).otherwise(0).cast("long")
    return rows.select(F.col("id").alias(id_col), "size", "source_size", "target",
                       (F.col("size") * copies).alias("taken"), "source", copies.alias("copies"))
