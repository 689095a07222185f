"""N-gram Jaccard join by token-combination prefixes.

A document's set is its distinct ``k``-word shingles. Documents link when the Jaccard similarity of their sets
is at least ``percent`` / 100. The shingles are ordered by (class, hash), the rare class before the
frequent class.

* Two linked sets share at least j shingles in their prefixes of ``n - ceil(t n) + j`` shingles.
* If they share a rare shingle in the prefixes for j = 1, it is a common signature by itself.
* Otherwise both prefixes reach into the frequent class, hold all rare shingles of their documents, and the
  two shingles shared in the prefixes extended to j = 2 are both frequent: their pair is a common signature.
* The number of pairs is quadratic in the prefix. Sets of more than ``combine_to`` shingles use their frequent
  prefix shingles singly; sets from ``t * combine_to`` to ``combine_to`` do both, so that linked sets of
  different sizes always have a common kind of signature.

The class only steers the cost: any class function gives the same links. Shingles that no other set holds are a
third class before the rare one; they fill the front of the prefixes, can't be shared and are not indexed. A
shingle is frequent when more than ``max(32, shingles of the corpus / 2**21)`` sets hold it, so there are at most
2**21 frequent ones: 16 MB to broadcast at every corpus size, besides a bitmap of at most 16 MB. Equal sets are one
vertex.

Members of a signature are compared with its smallest member first (a star, not all pairs). Once linked
members have one component, only members of one signature that are still in different components are
compared with each other, so no link between different components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contactlift.llm import words as W
from contactlift.llm.store import components, fresh, parts_of, written

FREQUENT_MAX = 1 << 21
BITMAP_MAX = 1 << 27
BLOOM_BITS = 1 << 27
# Sets are compared by the first 6 bytes of their shingles' hashes: two unequal shingles of a pair of sets of n
# shingles look equal with a chance of n * n / 2**48.
WIDTH = 6
MARKS = 16


def ceil_share(n: int, percent: int) -> int:
    return -(-n * percent // 100)


def set_id(u: np.ndarray) -> int:
    """One 64-bit number for a set of shingles."""
    return int(W.mix(np.array([u.sum(dtype=np.uint64) ^ np.uint64(len(u) * 0x9E3779B97F4A7C15 % 2**64)]))
               .view(np.int64)[0])


def _sets(batch: pa.RecordBatch, text: str, k: int) -> Iterator[tuple[int, np.ndarray]]:
    for run in W.runs(batch.column(text)):
        for i in range(len(run)):
            yield run.row + i, W.shingle_set(run.hashes[run.first[i]:run.first[i + 1]], k)


def _distinct_sets(batches, text, k):
    """Sets of a batch, equal ones once."""
    for b in batches:
        seen = set()
        for _, u in _sets(b, text, k):
            if len(u) and (v := set_id(u)) not in seen:
                seen.add(v)
                yield v, u


def _meta(docs: DataFrame, id_col: str, text: str, k: int) -> DataFrame:
    def task(batches):
        for b in batches:
            n, v = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, u in _sets(b, text, k):
                n[i] = len(u)
                v[i] = set_id(u) if len(u) else 0
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(n), pa.array(v)], ["id", "n", "v"])

    return docs.select(id_col, text).mapInArrow(task, "id long, n long, v long")


def _blobs(docs: DataFrame, parts: int, make, code, per: int = 1 << 21) -> DataFrame:
    """Run ``make(batches)``, which yields (part numbers, records), and send the coded records to their part."""
    def task(batches):
        held, size = [], 0

        def flush():
            part = np.concatenate([p for p, _ in held])
            rec = np.concatenate([r for _, r in held])
            got = W.split_by(part, parts)
            return pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in got], pa.int32()), W.binary([code(rec[i]) for _, i in got])],
                ["part", "blob"])

        for part, rec in make(batches):
            held.append((part, rec))
            size += len(rec)
            if size > per:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return docs.mapInArrow(task, "part int, blob binary").repartition(min(parts, parts_of(docs.sparkSession)), "part")


def _gathered(batches, decode) -> dict[int, np.ndarray]:
    got: dict[int, list] = {}
    for b in batches:
        for p, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            got.setdefault(p, []).append(decode(x))
    return {p: np.concatenate(x) for p, x in got.items()}


class Classes:
    """The class of each shingle: 0 held by one set only, 1 rare, 2 frequent.

    ``twice`` is a bitmap over the leading bits of the hashes with a bit for every shingle held at least twice; a
    shingle whose bit is clear is in no other set. ``often`` are the 40-bit prefixes of the frequent ones, sorted.
    """

    def __init__(self, twice: np.ndarray, often: np.ndarray):
        self.twice, self.often = twice, often
        self.shift = 64 - (8 * len(twice)).bit_length() + 1

    def of(self, u: np.ndarray) -> np.ndarray:
        at = u >> np.uint64(self.shift)
        bit = (self.twice[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
        return np.where(W.member(u >> np.uint64(24), self.often), 2, bit)


def shingle_classes(docs: DataFrame, text: str, k: int, total: int, least: int | None = None) -> Classes:
    """Count in how many sets each shingle occurs (by the first 40 bits of its hash; a clash only moves a class).

    The bitmap has about four bits for each shingle of the corpus, from 2**16 to ``BITMAP_MAX`` bits. In a corpus
    beyond that bound more single shingles look shared, which costs signatures and loses none.
    """
    bits = 1 << min(max(int(total * 4).bit_length(), 16), BITMAP_MAX.bit_length() - 1)
    fine = min(bits, 1 << 40)
    parts = 256
    least = max(32, total // FREQUENT_MAX) if least is None else least

    def make(batches):
        for _, u in _distinct_sets(batches, text, k):
            x = u >> np.uint64(24)
            yield (x >> np.uint64(32)).astype(np.int64), x

    def count(batches):
        for p, x in _gathered(batches, lambda b: W.unpack(b, 5)).items():
            value, n = np.unique(x, return_counts=True)
            slot = np.zeros(fine // parts, bool)
            at = value[n > 1] >> np.uint64(40 - (fine.bit_length() - 1))
            slot[(at - np.uint64(p * (fine // parts))).astype(np.int64)] = True
            yield pa.RecordBatch.from_arrays(
                [pa.array([p], pa.int32()), W.binary([np.packbits(slot, bitorder="little").tobytes()]),
                 W.binary([value[n > least].tobytes()])], ["part", "twice", "often"])

    got = (_blobs(docs.select(text), parts, make, lambda x: W.pack(np.sort(x), 5))
           .mapInArrow(count, "part int, twice binary, often binary").collect())
    twice = np.zeros((parts, fine // parts // 8), np.uint8)
    for r in got:
        twice[r["part"]] = np.frombuffer(r["twice"], np.uint8)
    often = [np.frombuffer(r["often"], np.uint64) for r in got]
    return Classes(twice.ravel(), np.sort(np.concatenate(often)) if often else np.zeros(0, np.uint64))


def signatures(u: np.ndarray, kind: np.ndarray, percent: int, combine_to: int) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of one set, given its shingles' classes: hashes, and whether they come from the frequent class.
    Shingles that no other set holds fill the front of the prefix and are not emitted."""
    n = len(u)
    none = np.zeros(0, np.uint64), np.zeros(0, bool)
    if n < 2:  # a one-shingle set links only with its equal
        return none
    p1 = n - ceil_share(n, percent) + 1
    alone = int((kind == 0).sum())
    if alone >= p1:
        return none
    rare, often = u[kind == 1][:p1 - alone], u[kind == 2]
    out, frequent = [rare], [np.zeros(len(rare), bool)]
    if alone + len(rare) < p1:
        before = alone + len(rare)
        if n <= combine_to:
            f = often[:min(p1 + 1, n) - before]
            i, j = np.triu_indices(len(f), 1)
            out.append(W.mix(f[i] * np.uint64(0xA24BAED4963EE407) + f[j]))
            frequent.append(np.ones(len(i), bool))
        if 100 * n > percent * combine_to:
            f = often[:p1 - before]
            out.append(f)
            frequent.append(np.ones(len(f), bool))
    return np.concatenate(out), np.concatenate(frequent)


_PAIR = np.dtype([("sig", np.uint64), ("v", np.int64), ("own", np.int32), ("n", np.int32)])


def shared_signatures(docs: DataFrame, text: str, k: int, percent: int, combine_to: int,
                      classes: Classes) -> DataFrame:
    """(sig, v, own, n): signatures that at least two different sets hold, their sets' sizes and how many of their
    shingles no other set holds. Signatures of the frequent class may be held by any share of all documents, so they
    are dealt by their holder and kept without a count."""
    parts = parts_of(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(classes)

    def make(batches):
        for v, u in _distinct_sets(batches, text, k):
            kind = held.value.of(u)
            sig, often = signatures(u, kind, percent, combine_to)
            rec = np.empty(len(sig), _PAIR)
            rec["sig"], rec["v"], rec["own"], rec["n"] = sig, v, (kind == 0).sum(), len(u)
            deal = np.where(often, W.mix(np.array([v]).view(np.uint64)), sig) >> np.uint64(33)
            yield (deal % np.uint64(parts)).astype(np.int64) + np.where(often, parts, 0), rec

    def keep(batches):
        for p, rec in _gathered(batches, lambda b: np.frombuffer(b, _PAIR)).items():
            rec = np.unique(rec)
            if p < parts:
                same = rec["sig"][1:] == rec["sig"][:-1]
                rec = rec[np.concatenate([same, [False]]) | np.concatenate([[False], same])]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(rec["sig"]).view(np.int64)), *(pa.array(rec[c]) for c in ("v", "own", "n"))],
                ["sig", "v", "own", "n"])

    return (_blobs(docs.select(text), 2 * parts, make, lambda x: x.tobytes())
            .mapInArrow(keep, "sig long, v long, own int, n int"))


def _bloom(values: DataFrame) -> np.ndarray:
    """A Bloom filter (one hash, at most 16 MB) of a long column, as 64-bit words."""
    got = (values.select(F.xxhash64("v").bitwiseAND(BLOOM_BITS - 1).alias("at"))
           .selectExpr("shiftright(at, 6) AS w", "shiftleft(1L, cast(at & 63 AS int)) AS bit")
           .groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(BLOOM_BITS // 64, np.int64)
    out[np.asarray(got.column("w"))] = np.asarray(got.column("bits"))
    return out


def _xxhash_long(v: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a long column (seed 42)."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                                                 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    def rot(x, r):
        return (x << np.uint64(r)) | (x >> np.uint64(64 - r))
    h = np.full(len(v), 42, np.uint64) + p5 + np.uint64(8)
    h ^= rot(v.view(np.uint64) * p2, 31) * p1
    h = rot(h, 27) * p1 + p4
    h = (h ^ (h >> np.uint64(33))) * p2
    h = (h ^ (h >> np.uint64(29))) * p3
    return h ^ (h >> np.uint64(32))


def _coded(u: np.ndarray) -> bytes:
    return W.pack(u >> np.uint64(64 - 8 * WIDTH), WIDTH)


def _marks(u: np.ndarray) -> np.ndarray:
    """The parities of the numbers of shingles in 64 * MARKS cells. The parities of two sets differ in at most as many cells
    as the sets in shingles, and common shingles cancel out, so the bound is sharp for large sets too."""
    n = np.bincount((u & np.uint64(64 * MARKS - 1)).astype(np.int64), minlength=64 * MARKS)
    return np.packbits((n & 1).astype(bool)).view(np.int64)


def _wanted_sets(docs: DataFrame, text: str, k: int, vertices: DataFrame) -> DataFrame:
    """(v, n, u): the sets of the given vertices, once each. The Bloom filter only saves shuffling the others."""
    held = docs.sparkSession.sparkContext.broadcast(_bloom(vertices))

    def task(batches):
        for b in batches:
            got = list(_distinct_sets([b], text, k))
            v = np.array([v for v, _ in got], np.int64)
            at = _xxhash_long(v) & np.uint64(BLOOM_BITS - 1)
            ok = (held.value.view(np.uint64)[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
            keep = np.flatnonzero(ok)
            marks = np.stack([_marks(got[i][1]) for i in keep] or [np.zeros(MARKS, np.int64)])[:len(keep)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(v[keep]), pa.array([len(got[i][1]) for i in keep], pa.int32()),
                 W.binary([_coded(got[i][1]) for i in keep]),
                 *(pa.array(np.ascontiguousarray(marks[:, j])) for j in range(MARKS))], names)

    names = ["v", "n", "u", *(f"m{j}" for j in range(MARKS))]
    kinds = ["long", "int", "binary"] + ["long"] * MARKS
    got = docs.select(text).mapInArrow(task, ", ".join(map(" ".join, zip(names, kinds))))
    return got.groupBy("v").agg(F.min(F.struct(*names[1:])).alias("s")).select("v", "s.*")


def _possible(percent: int, n1: str, own1: str, n2: str, own2: str) -> Column:
    """Whether two sets can reach the similarity, given their sizes and how many shingles no other set holds."""
    both = F.least(F.col(n1) - F.col(own1), F.col(n2) - F.col(own2)).cast("long")
    return 100 * both >= percent * (F.col(n1) + F.col(n2) - both)


def _linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the pairs (a, b) whose sets reach the similarity."""
    def task(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = W.unpack(x.as_py(), WIDTH), W.unpack(y.as_py(), WIDTH)
                if len(x) > len(y):
                    x, y = y, x
                both = int(W.member(x, y).sum())
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    left = sets.select(F.col("v").alias("a"), F.col("n").alias("na"), F.col("u").alias("ua"))
    right = sets.select(F.col("v").alias("b"), F.col("n").alias("nb"), F.col("u").alias("ub"))
    fit = (100 * F.least("na", "nb") >= percent * F.greatest("na", "nb"))
    return (pairs.select("a", "b").join(left, "a").join(right, "b").where(fit)
            .select("a", "b", "ua", "ub").mapInArrow(task, "a long, b long"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80,
                    combine_to: int = 160, frequent_from: int | None = None) -> DataFrame:
    """One row per row of ``docs``: (id_col, n_shingles, component_id).

    ``component_id`` is the smallest id reachable by links, itself included. A null or word-free text has an empty
    set, links with nothing and is its own component. A text of fewer than ``k`` words is one shingle. Rows with a
    null id take part like others; their own component is null when no linked row has an id. Rows that share an id
    are separate documents. Extra columns are ignored. An empty table gives an empty result.
    """
    docs = docs.select(F.col(id_col).cast("long").alias(id_col), text)
    meta = written(_meta(docs, id_col, text, k), "sets")
    total = meta.agg(F.sum("n")).first()[0] or 0
    classes = shingle_classes(docs, text, k, int(total), frequent_from)
    live = written(shared_signatures(docs, text, k, percent, combine_to, classes), "signatures")
    sets = written(_wanted_sets(docs, text, k, live.select("v").distinct()), "members")

    # each member with the one of its signatures that has the smallest share of shingles of its own (the text that
    # the others were made from, if it is there), the most often shared one first
    low = (live.groupBy("sig").agg(F.min(F.struct((F.col("own") / F.col("n")).alias("r"), "v", "own", "n")).alias("c"))
           .select("sig", F.col("c.v").alias("b"), F.col("c.own").alias("ob"), F.col("c.n").alias("nb")))
    star = written(live.join(low, "sig").where(F.col("v") != F.col("b")).where(_possible(percent, "n", "own", "nb", "ob"))
                   .groupBy(F.col("v").alias("a"), "b").agg(F.count("*").alias("shared")), "star")
    first = star.groupBy("a").agg(F.max(F.struct("shared", "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    edges = written(_linked(first, sets, percent), "links")
    label = components(edges)

    la, lb = label.select(F.col("v").alias("a"), F.col("label").alias("la")), label.select(
        F.col("v").alias("b"), F.col("label").alias("lb"))
    apart = F.coalesce("la", "a") != F.coalesce("lb", "b")
    second = (star.join(first, ["a", "b"], "left_anti").join(la, "a", "left").join(lb, "b", "left").where(apart)
              .select("a", "b"))
    more = written(_linked(second, sets, percent), "links")
    if not more.isEmpty():
        edges = edges.union(more)
        label = components(edges)

    # members of one signature that are not in one component yet
    part = live.join(label, "v", "left").select("sig", "v", "own", "n", F.coalesce("label", "v").alias("label"))
    # a set can still link with a smaller one, which may lie in it whole: only its own size bounds the union here
    part = written(part.where(100 * (F.col("n") - F.col("own")).cast("long") >= percent * F.col("n")), "open")
    mixed = part.groupBy("sig").agg(F.min("label").alias("l"), F.max("label").alias("m")).where("l <> m").select("sig")
    marks = [f"m{j}" for j in range(MARKS)]
    part = part.join(mixed, "sig").join(sets.select("v", *marks), "v")
    cols = ["v", "label", "n", "own", *marks]
    x = part.select("sig", *(F.col(c).alias(d) for c, d in zip(cols, ["a", "la", "na", "oa", *(f"x{j}" for j in range(MARKS))])))
    y = part.select("sig", *(F.col(c).alias(d) for c, d in zip(cols, ["b", "lb", "nb", "ob", *(f"y{j}" for j in range(MARKS))])))
    differ = sum((F.bit_count(F.col(f"x{j}").bitwiseXOR(F.col(f"y{j}"))) for j in range(MARKS)), F.lit(0))
    near = 100 * (F.col("na") + F.col("nb") - differ) >= percent * (F.col("na") + F.col("nb") + differ)
    rest = (x.join(y, "sig").where((F.col("a") < F.col("b")) & (F.col("la") != F.col("lb"))
                                   & _possible(percent, "na", "oa", "nb", "ob") & near)
            .select("a", "b").distinct())
    tried = star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = written(rest.join(tried, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        more = written(_linked(rest, sets, percent), "links")
        if not more.isEmpty():
            label = components(edges.union(more))

    named = (meta.where("n > 0").groupBy("v").agg(F.min("id").alias("id")).join(label, "v", "left")
             .select("v", "id", F.coalesce("label", "v").alias("label")))
    low_id = named.groupBy("label").agg(F.min("id").alias("component_id"))
    to = named.join(low_id, "label").select("v", "component_id")
    out = meta.join(to.withColumn("some", F.lit(True)), (meta["v"] == to["v"]) & (meta["n"] > 0), "left")
    return out.select(meta["id"].alias(id_col), meta["n"].alias("n_shingles"),
                      F.when(F.col("some"), F.col("component_id")).otherwise(meta["id"]).alias("component_id"))


def one_of_each_group(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """``docs``, all columns, with one row of every group of linked or equal documents: the one with the smallest id (null
    last; the first read of equal ids). Rows with word-free texts stay. ``docs`` must be a stored table: rows are numbered."""
    row = fresh(docs, "_row")
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    group = near_duplicates(rows, row, text, k, percent).select(F.col(row).alias("r"), "component_id")
    named = rows.select(row, F.col(id_col).alias("i")).join(group, F.col(row) == F.col("r"))
    keep = (named.groupBy("component_id").agg(F.min(F.struct(F.col("i").isNull().alias("none"), "i", "r")).alias("m"))
            .select(F.col("m.r").alias(row)))
    return rows.join(keep, row, "left_semi").drop(row)
