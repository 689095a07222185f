"""Importance resampling: draw the documents that look most like a target corpus, with a seeded Gumbel score.

1. **Array-scored weights**: a text's features are its words and pairs of neighbouring words, each hashed to one of
   ``BUCKETS`` buckets. Every task sums a count array; the summed arrays of the corpus and of the target give one gain per
   bucket, and a document's weight is the floored mean of its features' gains, looked up in that array (fixed size).
   score = weight + a Gumbel variate made from the document's id and the seed, so the highest scores are a draw without
   replacement with odds that grow with the weight.
2. **Sorting by regular sampling**: the eligible rows are written as locally sorted runs. Every n-th row of each run goes
   to the driver (``SAMPLES`` for each segment and at most one more for each run), and every ``SAMPLES``-th of the sorted
   sample is a splitter. A run's slices between splitters are exchanged, so that each task gets one segment, and are merged
   by a local sort. Prefix sums of the segments' counts turn the place in a segment into the exact rank.
   The order is score (highest first), doc_id, place in the written runs, so equal scores are split too.

Null texts have no features. Null ``doc_id``: its variate is made from the empty id, and it comes after all others of its
score. Rows that repeat are drawn one by one. Extra columns are not read. An empty target gives gains by corpus counts
alone. With a text of any length, at most ``PIECE`` bytes of it are split at a time.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import repeat
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlift.llm.store import parts_of, written

BUCKETS = 10000
PIECE = 1 << 20
# Sampled rows for each splitter; a segment then holds about n / segments rows, and at most that plus runs * n / (segments * SAMPLES).
SAMPLES = 64
SEGMENT_ROWS = 1 << 20

# What a word is made of, after A-Z are lower-cased (bytes of UTF-8).
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_GAP = re.compile(rb"[^0-9a-zA-Z\x80-\xff]")


def features(raw: bytes | None) -> Iterator[tuple[int, list[int]]]:
    """(words, crc32 of every feature) for each piece of a text; pairs over the pieces' edges included."""
    at, n, open_ = 0, len(raw or b""), []
    while at < n:
        cut = _GAP.search(raw, at + PIECE) if at + PIECE < n else None
        to = cut.start() if cut else n
        words = _WORD.findall(raw[at:to].lower())
        one = list(map(crc32, words))
        if one:
            begun = open_ + list(map(crc32, repeat(b" "), one))  # the crc of "word " is what the next word goes on from
            yield len(one), one + list(map(crc32, words if open_ else words[1:], begun))
            open_ = begun[-1:]
        at = to


def feature_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows of ``texts`` (column text)."""
    def per_task(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in _raw(batch["text"]):
                for _, codes in features(raw):
                    total += np.bincount(np.array(codes, np.int64) % buckets, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(per_task, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]  # one row per bucket
    return out


def _raw(column: pa.Array) -> Iterator[bytes | None]:
    column = column.cast(pa.large_string()).cast(pa.large_binary())
    return (x.as_py() for x in column)


def bucket_gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of each bucket's smoothed share in the target over its share in the corpus."""
    s, t, k = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log(((b + 1) * (s + k)) / ((a + 1) * (t + k))))
                     for a, b in zip(corpus.tolist(), target.tolist())], np.int64)


def scored(docs: DataFrame, gains: np.ndarray, seed: int) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score) of every document."""
    def per_batch(batches):
        for batch in batches:
            rows = []
            for raw in _raw(batch["text"]):
                n, total, words = 0, 0, 0
                for k, codes in features(raw):
                    words += k
                    n += len(codes)
                    total += int(gains[np.array(codes, np.int64) % len(gains)].sum())
                rows.append((words, n, total // n if n else 0))
            noise = [math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))) for h in batch["h"].to_pylist()]
            words, n, weight = (list(c) for c in zip(*rows)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], *[pa.array(c, pa.int64()) for c in (words, n, weight, [w + g for w, g in zip(weight, noise)])]],
                ["doc_id", "n_words", "n_features", "weight", "score"])

    number = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", number.cast("long").alias("h")).mapInArrow(
        per_batch, "doc_id long, n_words long, n_features long, weight long, score long")


_LAST = (1 << 63) - 1


def ranked(rows: DataFrame, first: int | None = None) -> DataFrame:
    """``rows`` (with columns score and doc_id) with their exact ``rank`` by score, highest first; null beyond ``first``."""
    spark, columns = rows.sparkSession, rows.columns
    runs = written(rows.sortWithinPartitions(F.desc("score"), F.asc_nulls_last("doc_id"))
                   .withColumn("place", F.monotonically_increasing_id()), "sorted-runs")
    n = runs.count()
    segments = max(parts_of(spark), math.ceil(n / SEGMENT_ROWS))
    each = max(1, n // (segments * SAMPLES))
    # place counts up within a run, so this takes every each-th row of each run, the run's last part-step left out
    inner = F.col("place").bitwiseAND((1 << 33) - 1)
    picked = runs.where(inner % each == each - 1).select("score", "doc_id", "place").collect()
    keys = sorted((-r["score"], _LAST if r["doc_id"] is None else r["doc_id"], r["place"]) for r in picked)
    step = max(1, math.ceil(len(keys) / segments))
    splitters = keys[step - 1::step][:segments - 1]

    def cut(batches):
        for batch in batches:
            doc = batch["doc_id"].fill_null(_LAST).to_pylist()
            # a batch may hold the ends of several runs, as small files are read together: each row is placed for itself
            segment = [bisect_left(splitters, key) for key in zip((-x for x in batch["score"].to_pylist()), doc, batch["place"].to_pylist())]
            yield batch.append_column("segment", pa.array(segment, pa.int32()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in runs.schema)
    dealt = runs.mapInArrow(cut, f"{kinds}, segment int")
    sizes = {r["segment"]: r["count"] for r in dealt.groupBy("segment").count().collect()}  # one row per segment
    offset = np.cumsum([0, *[sizes.get(i, 0) for i in range(segments)]]).tolist()
    # element_at over a literal array: one number per segment
    before = F.element_at(F.lit(offset).cast("array<long>"), F.col("segment") + 1)
    merged = (dealt.repartitionById(segments, F.col("segment"))
              .sortWithinPartitions(F.desc("score"), F.asc_nulls_last("doc_id"), "place"))
    rank = before + F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) + 1
    out = merged.withColumn("rank", rank).select(*columns, "rank")
    return out if first is None else out.withColumn("rank", F.when(F.col("rank") <= first, F.col("rank")))


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7) -> DataFrame:
    """Every document with its features, weight, score and its rank among the drawn ones (null: not drawn).

    ``percent`` of the documents with at least ``least_words`` words are drawn.
    """
    gains = bucket_gains(feature_counts(docs), feature_counts(target))
    table = written(scored(docs, gains, seed), "scored")
    fit = table.where(F.col("n_words") >= least_words)
    drawn = ranked(fit, percent * fit.count() // 100)
    rest = table.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return drawn.unionByName(rest).select("doc_id", "n_words", "n_features", "weight", "score", "rank")
