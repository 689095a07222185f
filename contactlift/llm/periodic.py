"""Runs of periodic words: maximal stretches with smallest period q and at least max(6, 4 * q) words.

w[i] = w[i + q] holds for every i of a stretch but its last q words; call these i the *matches* of q. A run is a
maximal interval of matches, so pieces of it that overlap can be found apart and put together again.

1. **Tiles** (``tiles``): an octave k holds the periods 2^k to 2^(k+1) - 1. Boundaries lie B = 2^(k+1) words apart. A run
   of the octave has so many matches that one of its boundaries is followed by a gram of ``_gram(k)`` words that recurs one
   period on; the others are no boundary of a run. A document's tile holds such boundaries of one cell of the grid and the
   words around them, B before and what a period needs behind, so tiles overlap. Tiles are rows, dealt over the cluster.
2. **Boundary Z-functions** (``_solve``): the Z-function of the words from a boundary on gives the matches behind it for
   each period of the octave, a backward comparison those before it. Periods whose first block is a power of a shorter
   one are left to that one (the whole run then has the shorter period).
3. **Stitching** (``runs``): pieces go to their document and period, overlapping ones become intervals, and of
   intervals with the same words the smallest period stays (the others are its multiples).

Grams are compared by 64-bit hashes only to choose tiles; the tiles themselves hold word numbers of 64-bit word hashes.
A document is known by its id and a 64-bit hash of id and text, so rows that repeat give equal results, each its own row.
Null text: no words. Null ``doc_id``: kept, and never rewritten. Extra columns are not read. The largest thing a task holds is one
document, or a tile, of at most 3.5 times its words.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contactlift.llm import words as W
from contactlift.llm.store import written

LEAST, TIMES = 6, 4  # a run's words, and its words in periods
# A tile's cell spans the boundary distance of its octave, or this many words if that is less.
CELL = 4096
# Boundaries whose periods are compared at a time (elements of the comparison).
CHUNK = 1 << 20

_FIRST = "id long, key long, doc_id long, n long, plain string, words binary, octave int, cell long, at long, marks binary, codes binary"
_A, _B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)

Rewrite = Callable[[int, int], np.ndarray | None]


def _gram(k: int) -> int:
    return {0: 4, 1: 3}.get(k, 1 << k)


def _next(h: np.ndarray, g: np.ndarray, by: int) -> np.ndarray:
    """Hashes of the grams that ``h`` begins and ``g``, ``by`` words on, ends. The last ``by`` ones are of no use."""
    out = h * _A
    out[:len(h) - by] += g[by:] * _B
    return W.mix(out)


def _grams(h: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray]]:
    """(octave, hash of the gram at each word) for octaves 0 to ``top``."""
    two = _next(h, h, 1)
    yield 0, _next(two, two, 2)
    if top:
        yield 1, _next(two, h, 2)
    size, now = 2, two
    for k in range(2, top + 1):
        now = _next(now, now, size)
        size *= 2
        yield k, now


def _hits(h: np.ndarray, first: np.ndarray, top: int) -> Iterator[tuple[int, np.ndarray]]:
    """(octave, boundaries whose gram recurs a period of the octave on) over concatenated documents, whose words have hashes
    of their own."""
    long = np.diff(first)
    for k, gram in _grams(h, top):
        low, step = 1 << k, 2 << k
        enough = long >= max(LEAST, TIMES * low)
        if not enough.any():
            return
        marks = np.arange(0, len(h), step)
        marks = marks[enough[np.searchsorted(first, marks, "right") - 1]]
        # windows that leave the table are compared with the filler, which no gram equals but by chance
        filled = np.concatenate([gram, np.zeros(2 * step, np.uint64)])
        view = np.lib.stride_tricks.sliding_window_view(filled, low)
        found = []
        for i in range(0, len(marks), max(1, CHUNK // low)):
            part = marks[i:i + max(1, CHUNK // low)]
            found.append(part[(view[part + low] == gram[part][:, None]).any(axis=1)])
        yield k, np.concatenate(found) if found else marks[:0]


def tiles(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """One row for each document, with its words if it has tiles, and one for each tile (``octave`` is not null).

    ``rewrite(doc_id, n)`` may give the numbers of the words that stand for a document's n words.
    """
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("plain", pa.string()),
                        ("words", pa.binary()), ("octave", pa.int32()), ("cell", pa.int64()), ("at", pa.int64()),
                        ("marks", pa.binary()), ("codes", pa.binary())])

    def per_batch(batches):
        for batch in batches:
            for run in W.runs(batch["text"], cased=True):
                yield from _of_run(run, batch, rewrite, schema)

    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text",
                        F.xxhash64(F.col("doc_id").cast("long"), "text").alias("key"))
    return keyed.mapInArrow(per_batch, _FIRST)


def _of_run(run: W.Run, batch: pa.RecordBatch, rewrite: Rewrite | None, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    ids = batch["doc_id"].slice(run.row, len(run)).to_pylist()
    keys = batch["key"].slice(run.row, len(run)).to_pylist()
    first = run.first.astype(np.int64)
    source, h = None, run.hashes
    for i, doc in enumerate(ids):
        a, b = int(first[i]), int(first[i + 1])
        new = rewrite(doc, b - a) if rewrite and doc is not None and b > a else None
        if new is not None:
            source = np.arange(len(h)) if source is None else source
            source[a:b] = a + new
    if source is not None:
        h = h[source]
    own = h ^ np.repeat(W.mix(np.arange(1, len(run) + 1, dtype=np.uint64)), np.diff(first))
    most = int(np.diff(first).max(initial=0))
    tiled = [(k, marks) for k, marks in _hits(own, first, max(0, most // TIMES).bit_length() - 1) if len(marks)] if most >= LEAST else []
    having = set()
    for _, marks in tiled:
        having.update((np.searchsorted(first, marks, "right") - 1).tolist())

    rows, size = [], 0
    body = run.data.tobytes()
    for i in range(len(run)):
        a, b = int(first[i]), int(first[i + 1])
        parts = body[int(run.begins[i]):int(run.begins[i + 1])].split()  # at the six separators
        if source is not None:
            parts = [parts[j] for j in (source[a:b] - a).tolist()]
        text = b" ".join(parts)
        rows.append({"id": -1 if ids[i] is None else ids[i], "key": keys[i], "doc_id": ids[i], "n": b - a,
                     "plain": hashlib.sha256(text).hexdigest(), "words": text if i in having else None})
    yield pa.RecordBatch.from_pylist(rows, schema)

    rows = []
    for k, marks in tiled:
        step = 2 << k
        doc = np.searchsorted(first, marks, "right") - 1
        cell = marks // max(step, CELL)
        cuts = np.flatnonzero((np.diff(doc) != 0) | (np.diff(cell) != 0)) + 1
        for part in np.split(np.arange(len(marks)), cuts):
            i = int(doc[part[0]])
            a, b = int(first[i]), int(first[i + 1])
            lo = max(a, int(marks[part[0]]) - step)
            hi = min(b, int(marks[part[-1]]) + step + _gram(k) + step)
            codes = np.unique(h[lo:hi], return_inverse=True)[1].astype("<i4")
            rows.append({"id": -1 if ids[i] is None else ids[i], "key": keys[i], "octave": k, "cell": int(cell[part[0]]), "at": lo - a,
                         "marks": (marks[part] - lo).astype("<i8").tobytes(), "codes": codes.tobytes()})
            size += hi - lo
            if size > CHUNK:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema)


def z_function(s: list, upto: int) -> list[int]:
    """For i below ``upto``, how many words from i on equal those from the start on."""
    z, n, left, right = [0] * min(upto, len(s)), len(s), 0, 0
    for i in range(1, len(z)):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def _solve(codes: np.ndarray, marks: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(period, first match, end of matches) of the octave in a tile, overlapping pieces joined.

    A piece that ends within its boundary's reach on both sides is whole, and dropped if it is too short.
    """
    low, step, gram = 1 << k, 2 << k, _gram(k)
    found: dict[int, list[list[int]]] = {}
    for b in marks.tolist():
        lo, reach = max(0, b - step), b + step + gram
        z = z_function(codes[b:reach + step].tolist(), step)
        p = 1
        for q in range(1, len(z)):
            while p < q and p + z[p] < q:
                p += 1
            if q < low or z[q] < gram or (p < q and q % p == 0):
                continue  # p is the smallest period of the first q words
            differ = np.flatnonzero(codes[lo:b][::-1] != codes[lo + q:b + q][::-1])
            start = b - (int(differ[0]) if len(differ) else b - lo)
            stop = min(b + z[q], reach)
            if start > lo and stop < reach and stop - start + q < max(LEAST, TIMES * q):
                continue
            pieces = found.setdefault(q, [])
            if pieces and start <= pieces[-1][1]:
                pieces[-1] = [min(pieces[-1][0], start), max(pieces[-1][1], stop)]
            else:
                pieces.append([start, stop])
    return [(q, start, stop) for q, pieces in found.items() for start, stop in pieces]


def _pieces(batches):
    for batch in batches:
        out: list[tuple] = []
        for i in range(batch.num_rows):
            row = {c: batch[c][i].as_py() for c in ("id", "key", "octave", "at", "marks", "codes")}
            codes = np.frombuffer(row["codes"], "<i4")
            out += [(row["id"], row["key"], q, row["at"] + start, row["at"] + stop)
                    for q, start, stop in _solve(codes, np.frombuffer(row["marks"], "<i8"), row["octave"])]
        columns = list(zip(*out)) if out else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["id", "key", "period", "start", "stop"])


def runs(tiled: DataFrame) -> DataFrame:
    """(id, key, start, length, period) of every run, from the table of ``tiles``."""
    dealt = (tiled.where("octave is not null").select("id", "key", "octave", "cell", "at", "marks", "codes")
             .repartition("id", "key", "octave", "cell"))
    pieces = dealt.mapInArrow(_pieces, "id long, key long, period long, start long, stop long")
    line = Window.partitionBy("id", "key", "period").orderBy("start", "stop")
    before = F.max("stop").over(line.rowsBetween(Window.unboundedPreceding, -1))
    islands = (pieces.withColumn("new", F.when(F.col("start") <= before, 0).otherwise(1))
               .withColumn("island", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
               .groupBy("id", "key", "period", "island")
               .agg(F.min("start").alias("start"), (F.max("stop") - F.min("start") + F.col("period")).alias("length")))
    whole = islands.where(F.col("length") >= F.greatest(F.lit(LEAST), F.col("period") * TIMES))
    return whole.groupBy("id", "key", "start", "length").agg(F.min("period").alias("period"))


_RESULT = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
           "collapsed_sha256 string")


def _digests(batches):
    names = [c.split()[0] for c in _RESULT.split(", ")]
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            text, found = batch["words"][i].as_py(), batch["runs"][i].as_py()
            parts = text.split(b" ")
            keep = np.ones(len(parts), bool)
            for r in found:
                keep[r["start"] + r["period"]:r["start"] + r["length"]] = False
            left = b" ".join([parts[j] for j in np.flatnonzero(keep).tolist()])
            best = min(found, key=lambda r: (-r["length"], r["start"], r["period"]))
            lines = "".join(f"{r['start']},{r['length']},{r['period']}\n" for r in found)
            rows.append(dict(zip(names, (batch["doc_id"][i].as_py(), len(found), best["start"], best["length"], best["period"],
                                         1000 * best["length"] // best["period"], hashlib.sha256(lines.encode()).hexdigest(),
                                         hashlib.sha256(left).hexdigest()))))
        yield pa.RecordBatch.from_pylist(rows, pa.schema([(n, pa.string() if "sha256" in n else pa.int64()) for n in names]))


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> tuple[DataFrame, DataFrame]:
    """(table of ``tiles``, runs) of ``docs``, both written: ``runs`` has one row for each run of each document."""
    tiled = written(tiles(docs, rewrite), "tiles")
    return tiled, written(runs(tiled), "runs")


def run_digests(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """One row per document: its number of runs, the longest one, and digests of all runs and of the words that stay when
    every run is cut to its first period."""
    tiled, found = periodic_runs(docs, rewrite)
    whole = tiled.where("octave is null")
    each = found.groupBy("id", "key").agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    # documents with tiles are few; the others are done
    joined = whole.where("words is not null").join(each, ["id", "key"], "left")
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    none = [F.lit(0).cast("long").alias("n_runs"), *[F.lit(None).cast("long").alias(c) for c in ("start", "length", "period", "exponent_milli")],
            empty.alias("runs_sha256"), F.col("plain").alias("collapsed_sha256")]
    out = joined.where("runs is not null").select("doc_id", "words", "runs").mapInArrow(_digests, _RESULT)
    return (out.unionByName(joined.where("runs is null").select("doc_id", *none))
            .unionByName(whole.where("words is null").select("doc_id", *none)))


def planted(doc_id: int, n: int) -> np.ndarray | None:
    """The query's rewriting: one document in ten repeats a stretch of its words up to its end."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    out = np.arange(n)
    out[a:] = a + (out[a:] - a) % p
    return out
