"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

For every benchmark item, windows of as many words as the item are slid over every document. A window's SimHash
(64 bits over its weighted ``k``-word shingles) is looked up in an index of the items of that length: 8 blocks of 8
bits, each block stored under all values within 2 bits. Two fingerprints that differ in at most 23 bits agree to
2 bits in some block, so all within that radius are found. Each candidate is verified by the exact weighted Jaccard
similarity of window and item, the weight of a shingle being how often it occurs.

A window that shares no shingle with an item has similarity 0, so only windows that hold a shingle of an item
of their length are fingerprinted. At the smallest accepted similarity (0.8) two fingerprints differ in 10 of 64 bits
on average (standard deviation 3), far inside the radius.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlift.llm import words as W

RADIUS = 23
BLOCK_TEXT = 64 << 20  # characters of benchmark text in one broadcast; a larger benchmark is matched in blocks
_NEAR = [0] + [1 << a for a in range(8)] + [1 << a | 1 << b for a, b in combinations(range(8), 2)]
_WEIGHT = np.array([bin(x).count("1") for x in range(256)], np.uint8)


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=-1)


def _votes(g: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.ascontiguousarray(g).view(np.uint8).reshape(-1, 8), axis=1)
    return bits.astype(np.int32) * 2 - 1


class Index:
    """The items of one block: shingles, fingerprints by length, and the Hamming index."""

    def __init__(self, items: list[tuple[int, str]], k: int):
        self.k, self.ids, self.bags, self.length = k, [], [], []
        owner: dict[int, set[int]] = {}
        short: dict[int, set[int]] = {}
        by_length: dict[int, list[int]] = {}
        prints = []
        for run in W.runs(pa.array([t for _, t in items], pa.string())):
            for i in range(len(run)):
                h = run.hashes[run.first[i]:run.first[i + 1]]
                if not len(h):
                    continue
                size = min(k, len(h))
                g = W.shingles(h, size)
                me = len(self.ids)
                self.ids.append(items[run.row + i][0])
                self.bags.append(Counter(g.tolist()))
                self.length.append(len(h))
                prints.append(_fingerprints(_votes(g).sum(0)))
                if size < k:
                    short.setdefault(size, set()).add(me)
                else:
                    by_length.setdefault(len(h), []).append(me)
                    for x in g.tolist():
                        owner.setdefault(x, set()).add(len(h))
        self.known = np.array(sorted(owner), np.uint64)
        self.lengths = [sorted(owner[x]) for x in self.known.tolist()]
        self.short = {n: {next(iter(self.bags[m])): [x for x in ms if self.bags[x] == self.bags[m]] for m in ms}
                      for n, ms in short.items()}
        self.tables = {}
        for n, ms in by_length.items():
            fp = np.array([prints[m] for m in ms])
            near = np.zeros((8, 256, len(ms)), bool)
            for b in range(8):
                for x in _NEAR:
                    near[b, fp[:, b] ^ x, np.arange(len(ms))] = True
            self.tables[n] = (np.array(ms), fp, near)

    def match(self, h: np.ndarray, g: np.ndarray, hits: np.ndarray) -> dict[int, tuple[float, int, int]]:
        """item -> (similarity, first word, words) of the best window, given the positions of known shingles."""
        best: dict[int, tuple[float, int, int]] = {}
        at: dict[int, list[int]] = {}
        for p, x in zip(hits.tolist(), np.searchsorted(self.known, g[hits]).tolist(), strict=True):
            for n in self.lengths[x]:
                at.setdefault(n, []).append(p)
        for n, ps in at.items():
            size = min(n, len(h))  # a document shorter than the item is one window
            span = size - self.k + 1
            p = np.array(ps)
            lo, hi = np.maximum(p - span + 1, 0), np.minimum(p, len(h) - size)
            edge = np.flatnonzero(lo[1:] > np.maximum.accumulate(hi)[:-1] + 1) + 1
            for a, b in zip([0, *edge], [*edge, len(p)], strict=True):
                first, last = int(lo[a]), int(hi[a:b].max())
                self._windows(g[first:last + span], span, first, size, n, best)
        return best

    def _windows(self, g, span, first, size, n, best):
        sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(_votes(g), axis=0, dtype=np.int32)])
        fp = _fingerprints(sums[span:] - sums[:-span])
        ms, own, near = self.tables[n]
        found = near[0, fp[:, 0]]
        for b in range(1, 8):
            found = found | near[b, fp[:, b]]
        for w, j in zip(*np.nonzero(found)):
            if int(_WEIGHT[fp[w] ^ own[j]].sum()) > RADIUS:
                continue
            m = int(ms[j])
            bag, mine = self.bags[m], Counter(g[w:w + span].tolist())
            both = sum(min(c, bag[x]) for x, c in mine.items() if x in bag)
            s = both / (span + sum(bag.values()) - both)
            if m not in best or s > best[m][0]:
                best[m] = (s, first + int(w), size)


def _matches(batch: pa.RecordBatch, text: str, index: Index, least: float):
    """(row, item, similarity, first word, words, code-point start, end) of a batch."""
    k = index.k
    for run in W.runs(batch.column(text)):
        g = W.shingles(run.hashes, k)
        row = np.repeat(np.arange(len(run)), np.diff(run.first))
        hit = np.flatnonzero(W.member(g, index.known) & (row[:len(g)] == row[k - 1:])) if len(g) else []
        got: dict[tuple[int, int], tuple[float, int, int]] = {}
        for i in np.unique(row[hit]) if len(hit) else []:
            a, b = run.first[i], run.first[i + 1]
            here = hit[np.searchsorted(hit, a):np.searchsorted(hit, b)]
            for m, x in index.match(run.hashes[a:b], g[a:b - k + 1], here - a).items():
                got[int(i), m] = x
        for size, table in index.short.items():  # items of fewer than k words match as a whole
            s = W.shingles(run.hashes, size)
            keys = np.array(sorted(table), np.uint64)
            for p in np.flatnonzero(W.member(s, keys) & (row[:len(s)] == row[size - 1:])) if len(s) else []:
                for m in table[int(s[p])]:
                    got.setdefault((int(row[p]), m), (1.0, int(p - run.first[row[p]]), size))
        for (i, m), (s, first, size) in sorted(got.items()):
            if s >= least:
                w = int(run.first[i]) + first
                c = run.codepoint(i, np.array([run.starts[w], run.ends[w + size - 1]]))
                yield run.row + i, index.ids[m], s, first, size, int(c[0]), int(c[1])


def _blocks(benchmark: DataFrame, item_id: str, item_text: str, k: int):
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(item_text).alias("t")).where("t IS NOT NULL")
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-int(size) // BLOCK_TEXT))
    for b in range(n):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == b)
        yield Index([(r[0], r[1]) for r in part.orderBy("i", "t").collect()], k)  # at most about BLOCK_TEXT characters


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text",
          item_id: str = "item_id", item_text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` and item that it holds: id_col, item_id, similarity, first_word, n_words, start, end
    (code points), for the best window with a similarity of at least ``percent`` / 100 (the first one on a tie).

    Null or word-free texts and items match nothing; an item of fewer than ``k`` words matches where its words occur
    in order; a document shorter than an item is compared as one window. Equal rows each get their rows; items that
    share an id are separate. Ids may be null. Extra columns are ignored; empty tables give an empty result.
    """
    out = None
    for index in _blocks(benchmark, item_id, item_text, k):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def task(batches, held=held):
            for b in batches:
                got = list(_matches(b, text, held.value, percent / 100))
                cols = list(zip(*got, strict=True)) if got else [[] for _ in range(7)]
                ids = b.column(id_col).take(pa.array(cols[0], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64()),
                     *(pa.array(c, pa.int64()) for c in cols[3:])],
                    [id_col, "item_id", "similarity", "first_word", "n_words", "start", "end"])

        part = docs.select(F.col(id_col).cast("long").alias(id_col), text).mapInArrow(
            task, f"`{id_col}` long, item_id long, similarity double, first_word long, n_words long, start long, end long")
        out = part if out is None else out.union(part)
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, without the rows that ``leaks`` would report."""
    out = docs
    for index in _blocks(benchmark, item_id, item_text, k):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def task(batches, held=held):
            for b in batches:
                keep = np.ones(b.num_rows, bool)
                keep[[m[0] for m in _matches(b, text, held.value, percent / 100)]] = False
                yield b.filter(pa.array(keep))

        out = out.mapInArrow(task, docs.schema)
    return out
