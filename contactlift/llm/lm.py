"""Language-model scoring with deleted interpolation.

The model mixes three maximum-likelihood estimates of a token after its context (the token before it): bigram,
unigram and uniform. The mixture weights depend on the bucket of the context's frequency (its binary logarithm) and are
learned by expectation-maximisation on held-out counts: the events of one part of the training documents under the
counts of the others. Contexts with fewer than 8 occurrences are one shared context, at every corpus size; the others are
kept apart, so the one table that is broadcast grows with the number of words seen 8 times.

All tokens are shuffled once, dealt by token (frequent tokens by token and context, so no task holds a hot one), with
the number of their document in its block; counts, held-out statistics and scores are taken from that one shuffle, and
the documents' partial sums go back to their blocks.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlift.llm import words as W
from contactlift.llm.chains import _planes, _records
from contactlift.llm.store import parts_of, written

END = np.uint64(0x5EED0E0D0C0B0A09)  # the end token, also the context of a text's first token
LEAST_COUNT = 8
FOLDS, TEST_FOLD, TUNE_FOLD = 7, 2, 3
BLOCK_TOKENS = 1 << 20  # tokens and documents of one block
BLOCK_DOCS = 1 << 15
PART_TOKENS = 3_000_000
MIN_PARTS = 32
SUB_PARTS = 4  # a part is worked off in so many pieces
_WORD = np.dtype([("w", np.uint64), ("c", np.uint32), ("d", np.uint32)])
_EVENT = np.dtype([("w", np.uint64), ("ctx", np.uint32), ("doc", np.uint16), ("m", np.uint32)])
_SUM = np.dtype([("doc", np.uint16), ("known", np.uint32), ("base", np.float64), ("score", np.float64)])
_STEP = 20  # histogram bins per power of ten of a probability ratio


def fold_of(doc_id) -> int:
    """crc32 of the id as text, modulo 7 (a null id counts as the empty text)."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS


def _blocks(batches, id_col: str, text: str):
    """Blocks of documents: (ids, folds, token counts, tokens, contexts, document numbers)."""
    held, tokens = [], 0

    def joined():
        ids = [x for h in held for x in h[0]]
        n = np.concatenate([h[1] for h in held])
        return ids, np.array([fold_of(i) for i in ids], np.int8), n, np.concatenate([h[2] for h in held])

    for b in batches:
        ids = b.column(id_col).to_pylist()
        for run in W.runs(b.column(text)):
            count = np.diff(run.first)
            held.append((ids[run.row:run.row + len(run)], count + 1, np.insert(run.hashes, run.first[1:], END)))
            tokens += len(run.hashes) + len(run)
            if tokens >= BLOCK_TOKENS or sum(len(h[0]) for h in held) >= BLOCK_DOCS:
                yield joined()
                held, tokens = [], 0
    if held:
        yield joined()


def _summed(keys: np.ndarray, *weights: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys and the sums of their weights."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return (k[cut], *(np.add.reduceat(w[order].astype(np.int64), cut) if len(cut) else np.zeros(0, np.int64)
                      for w in weights))


def word_counts(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Rows (w, c, d) of words with at least 8 training tokens (d: of them in the tuning fold), and for each part a row
    with a null word and its training tokens n, distinct words v, tuning tokens d and all tokens c."""
    parts = max(MIN_PARTS, parts_of(docs.sparkSession))

    def count(batches):
        for _, fold, n, tok in _blocks(batches, id_col, text):
            f = np.repeat(fold, n)
            w, c, d, every = _summed(tok, f != TEST_FOLD, f == TUNE_FOLD, np.ones(len(tok), bool))
            rec = np.empty(len(w), _WORD)
            rec["w"], rec["c"], rec["d"] = w, c, d
            got = W.split_by((w >> np.uint64(40)).astype(np.int64) % parts, parts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p, _ in got], pa.int32()), pa.array([int(every[i].sum()) for _, i in got], pa.int64()),
                 W.binary([_planes(rec[i]) for _, i in got])], ["part", "n", "blob"])

    def add(batches):
        got: dict[int, list] = {}
        total = 0
        for b in batches:
            total += sum(b.column(1).to_pylist())
            for p, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                got.setdefault(p, []).append(_records(x, _WORD))
        for p in sorted(got):
            rec = np.concatenate(got.pop(p))
            w, c, d = _summed(rec["w"], rec["c"], rec["d"])
            big = c >= LEAST_COUNT
            k = int(big.sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.append(w[big].view(np.int64), 0), mask=np.append(np.zeros(k, bool), True)),
                 pa.array(np.append(c[big], total)), pa.array(np.append(d[big], d.sum())),
                 pa.array([0] * k + [int(c.sum())], pa.int64()), pa.array([0] * k + [int((c > 0).sum())], pa.int64())],
                ["w", "c", "d", "n", "v"])
            total = 0

    return (docs.mapInArrow(count, "part int, n long, blob binary").repartition(min(parts, parts_of(docs.sparkSession)), "part")
            .mapInArrow(add, "w long, c long, d long, n long, v long"))


class Model:
    """What every task needs: corpus totals and the table of frequent words."""

    def __init__(self, n: int, v: int, d: int, words: np.ndarray, c: np.ndarray, tuned: np.ndarray):
        order = np.argsort(words)
        self.n, self.v, self.d = n, v, d
        self.words, self.c, self.tuned = words[order], c[order], tuned[order]
        rank = np.argsort(-self.c, kind="stable")  # frequent contexts get small numbers; 0 is the shared context
        self.number = np.empty(len(rank), np.uint32)
        self.number[rank] = np.arange(1, len(rank) + 1)
        self.ctx_c = np.concatenate([[n - int(self.c.sum())], self.c[rank]]).astype(np.float64)
        self.ctx_d = np.concatenate([[d - int(self.tuned.sum())], self.tuned[rank]]).astype(np.float64)
        self.bucket = np.concatenate([[0], 1 + np.log2(np.maximum(self.ctx_c[1:], 1)).astype(np.int64)])

    def find(self, w: np.ndarray) -> np.ndarray:
        """Row of each word in the table, or -1."""
        if not len(self.words):
            return np.full(len(w), -1)
        at = np.searchsorted(self.words, w)
        at[at == len(self.words)] = 0
        return np.where(self.words[at] == w, at, -1)


def _events(docs: DataFrame, id_col: str, text: str, model, parts: int) -> DataFrame:
    """(part, block, bounds, blob): events by token, and each block's documents."""
    def task(batches):
        m = model.value
        for serial, (ids, fold, n, tok) in enumerate(_blocks(batches, id_col, text)):
            block = (TaskContext.get().partitionId() << 24) + serial
            group = np.where(fold == TEST_FOLD, 2, np.where(fold == TUNE_FOLD, 1, 0))
            order = np.argsort(group, kind="stable")  # documents are numbered by group, so two bounds tell it
            number = np.empty(len(ids), np.uint16)
            number[order] = np.arange(len(ids))
            bounds = np.searchsorted(group[order], [1, 2]).astype(np.int32).tobytes()
            row = m.find(tok)
            ctx_of = np.where(row >= 0, m.number[row] if len(m.number) else 0, 0).astype(np.uint32)
            last = np.cumsum(n) - 1
            end = m.find(np.array([END], np.uint64))[0]
            start = m.number[end] if end >= 0 else np.uint32(0)
            ctx = np.concatenate([[start], ctx_of[:-1]]).astype(np.uint32)
            ctx[last[:-1] + 1] = start
            doc = np.repeat(number, n)
            key = W.mix(tok + ctx.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            deal = ((np.where(row >= 0, key, tok) >> np.uint64(24)) % np.uint64(parts)).astype(np.int64)  # as _deal
            o = np.lexsort((doc, key))
            same = np.concatenate([[True], (key[o][1:] != key[o][:-1]) | (doc[o][1:] != doc[o][:-1])])
            cut = np.flatnonzero(same)
            rec = np.empty(len(cut), _EVENT)
            i = o[cut]
            rec["w"], rec["ctx"], rec["doc"] = tok[i], ctx[i], doc[i]
            rec["m"] = np.diff(np.append(cut, len(o)))
            by = np.lexsort((rec["doc"], rec["ctx"], rec["w"]))
            rec, deal = rec[by], deal[i][by]
            got = W.split_by(deal, parts)
            info = pa.array([p for p, _ in got] + [parts + block % parts], pa.int32())
            table = pd.DataFrame({"id": pd.array([ids[x] for x in order], "Int64"), "n": n[order]}).to_parquet()
            yield pa.RecordBatch.from_arrays(
                [info, pa.array([block] * (len(got) + 1), pa.int64()), W.binary([bounds] * (len(got) + 1)),
                 W.binary([_planes(rec[x]) for _, x in got] + [table])], ["part", "block", "bounds", "blob"])

    return (docs.mapInArrow(task, "part int, block long, bounds binary, blob binary")
            .repartitionById(parts, F.pmod("part", F.lit(parts)).cast("int")))


def _deal(m: Model, w: np.ndarray, ctx: np.ndarray) -> np.ndarray:
    """The number that an event is dealt by: of its token, or of token and context for the frequent tokens."""
    key = W.mix(w + ctx.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return np.where(m.find(w) >= 0, key, w)


def _pieces(batches, parts: int, m: Model, extra=None):
    """The one part of a task in pieces: (blocks, records, block number of each record, document group, extra value). Rows of
    documents are passed on."""
    rows, value = [], None
    for b in batches:
        for i, p in enumerate(b.column("part").to_pylist()):
            block, bounds, blob = (b.column(c)[i].as_py() for c in ("block", "bounds", "blob"))
            if p >= parts:
                if extra:
                    yield block, blob
                continue
            if extra:
                value = b.column(extra)[i].as_py()
            rows.append((block, np.frombuffer(bounds, np.int32), _records(blob, _EVENT)))
    if not rows:
        return
    rec = np.concatenate([x[2] for x in rows])
    of = np.repeat(np.arange(len(rows), dtype=np.int32), [len(x[2]) for x in rows])
    bounds, blocks = np.array([x[1] for x in rows]), [x[0] for x in rows]
    del rows
    piece = ((_deal(m, rec["w"], rec["ctx"]) >> np.uint64(8)) % np.uint64(SUB_PARTS)).astype(np.int8)
    for p in range(SUB_PARTS):
        i = np.flatnonzero(piece == p)
        r, o = rec[i], of[i]
        group = (r["doc"] >= bounds[o, 0]).astype(np.int8) + (r["doc"] >= bounds[o, 1])
        yield blocks, r, o, group, value


def _counts(m: Model, rec: np.ndarray, group: np.ndarray):
    """For each event: training and tuning counts of its word, and of its word after its context."""
    train, tune = rec["m"] * (group < 2), rec["m"] * (group == 1)

    def spread(key):
        u, inverse = np.unique(key, return_inverse=True)
        return tuple(np.bincount(inverse, weights=x, minlength=len(u))[inverse] for x in (train, tune))

    c2, d2 = spread(W.mix(rec["w"] + rec["ctx"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    c1, d1 = spread(rec["w"])
    row = m.find(rec["w"])
    if len(m.words):
        c1, d1 = np.where(row >= 0, m.c[row], c1), np.where(row >= 0, m.tuned[row], d1)
    return c1, d1, c2, d2


def _by_document(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    u, inverse = np.unique(key, return_inverse=True)
    return (u, *(np.bincount(inverse, weights=z, minlength=len(u)) for z in values))


def _ratio(x: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(x > 0, np.rint(_STEP * np.log10(np.maximum(x, 1e-300))), -9999).astype(np.int32)


def _weights(hist: pd.DataFrame, rounds: int = 60) -> tuple[float, float, float]:
    """Mixture weights (bigram, unigram, uniform) by expectation-maximisation over a histogram of ratios."""
    r2 = np.where(hist["q2"] == -9999, 0.0, 10.0 ** (hist["q2"].to_numpy(float) / _STEP))
    r1 = np.where(hist["q1"] == -9999, 0.0, 10.0 ** (hist["q1"].to_numpy(float) / _STEP))
    p = np.stack([r2, r1, np.ones(len(hist))])
    w, lam = hist["m"].to_numpy(float), np.array([0.4, 0.4, 0.2])
    for _ in range(rounds):
        part = lam[:, None] * p
        lam = (part / part.sum(0) * w).sum(1) / w.sum()
        lam = np.maximum(lam, 1e-5)
        lam = lam / lam.sum()
    return tuple(lam)


def score_texts(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: id_col, held_out, n_tokens, n_known, train_tokens, base_score, score, n_words.

    Tokens are the words (A-Z lower-cased) and one end. A null or word-free text is the end alone. Documents whose
    crc32(id) modulo 7 is 2 are held out and never counted; a null id counts as an empty text. Rows that share an id are
    scored separately. With no training document all counts are 0. Extra columns are ignored; an empty table gives an
    empty result. ``docs`` must be a stored table (blocks are numbered by partition).
    """
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    spark = docs.sparkSession
    count = written(word_counts(docs, "id", "text"), "words")
    total = count.where("w IS NULL").agg(F.sum("n"), F.sum("v"), F.sum("d"), F.sum("c")).first()
    n, v, d, every = (int(x or 0) for x in total)
    top = count.where("w IS NOT NULL").where(F.col("c") >= LEAST_COUNT).select("w", "c", "d").toArrow()
    cols = [np.asarray(top.column(x)) for x in ("w", "c", "d")]
    model = spark.sparkContext.broadcast(Model(n, v, d, cols[0].astype(np.int64).view(np.uint64), cols[1], cols[2]))
    parts = max(MIN_PARTS, -(-every // PART_TOKENS))
    events = _events(docs, "id", "text", model, parts)

    def held_out(batches):
        m = model.value
        for _, rec, _, group, _ in _pieces(batches, parts, m):
            c1, d1, c2, d2 = _counts(m, rec, group)
            i = np.flatnonzero(group == 1)
            ctx = rec["ctx"][i]
            of = np.maximum(m.ctx_c[ctx] - m.ctx_d[ctx], 1)
            q2 = _ratio((c2[i] - d2[i]) / of * (m.v + 1))
            q1 = _ratio((c1[i] - d1[i]) / max(m.n - m.d, 1) * (m.v + 1))
            frame = pd.DataFrame({"b": m.bucket[ctx].astype(np.int32), "q2": q2, "q1": q1, "m": rec["m"][i].astype(np.int64)})
            yield pa.RecordBatch.from_pandas(frame.groupby(["b", "q2", "q1"], as_index=False)["m"].sum(), preserve_index=False)

    hist = (events.mapInArrow(held_out, "b int, q2 int, q1 int, m long").groupBy("b", "q2", "q1")
            .agg(F.sum("m").alias("m")))

    def learn(g: pd.DataFrame) -> pd.DataFrame:
        l2, l1, l0 = _weights(g)
        return pd.DataFrame({"b": [int(g["b"].iloc[0])], "l2": [l2], "l1": [l1], "l0": [l0]})

    learned = (hist.groupBy("b").applyInPandas(learn, "b int, l2 double, l1 double, l0 double")
               .agg(F.collect_list(F.struct("b", "l2", "l1", "l0")).alias("mix")))

    def scored(batches):
        m = model.value
        held, blocks = [], []
        for x in _pieces(batches, parts, m, "mix"):
            if len(x) == 2:
                yield pa.RecordBatch.from_arrays([pa.array([x[0]], pa.int64()), pa.array([True]), W.binary([x[1]])],
                                                 ["block", "table", "blob"])
                continue
            blocks, rec, of, group, mix = x
            lam = np.tile([0.4, 0.4, 0.2], (int(m.bucket.max()) + 1, 1))
            for r in mix or []:
                lam[r["b"]] = r["l2"], r["l1"], r["l0"]
            c1, _, c2, _ = _counts(m, rec, group)
            by = lam[m.bucket[rec["ctx"]]]
            p = by[:, 0] * c2 / np.maximum(m.ctx_c[rec["ctx"]], 1) + by[:, 1] * c1 / max(m.n, 1) + by[:, 2] / (m.v + 1)
            held.append(_by_document(of.astype(np.int64) * 65536 + rec["doc"], rec["m"] * (c1 > 0),
                                     rec["m"] * np.log10((c1 + 1) / (m.n + m.v + 1)), rec["m"] * np.log10(p)))
        if held:
            u, known, base, score = _by_document(*(np.concatenate(z) for z in zip(*held, strict=True)))
            out = np.empty(len(u), _SUM)
            out["doc"], out["known"], out["base"], out["score"] = u % 65536, known, base, score
            cut = np.searchsorted(u, np.arange(len(blocks) + 1) * 65536)
            yield pa.RecordBatch.from_arrays(
                [pa.array(blocks, pa.int64()), pa.array([False] * len(blocks)),
                 W.binary([_planes(out[cut[j]:cut[j + 1]]) for j in range(len(blocks))])], ["block", "table", "blob"])

    sums = events.select("part", "block", "bounds", "blob", learned.scalar().alias("mix")).mapInArrow(
        scored, "block long, table boolean, blob binary")

    def finished(batches):
        import io

        tables, got = {}, {}
        for b in batches:
            for block, is_table, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if is_table:
                    tables[block] = blob
                else:
                    got.setdefault(block, []).append(blob)
        for block in sorted(tables):
            t = pd.read_parquet(io.BytesIO(tables.pop(block)))
            rec = np.concatenate([_records(x, _SUM) for x in got.pop(block, [])])
            add = {c: np.bincount(rec["doc"], weights=rec[c], minlength=len(t)) for c in ("known", "base", "score")}
            ids = t["id"].astype("Int64")
            fold = np.array([fold_of(None if pd.isna(i) else int(i)) for i in ids])
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(fold == TEST_FOLD), pa.array(t["n"].to_numpy(np.int64)),
                 pa.array(add["known"].astype(np.int64)), pa.array(np.full(len(t), n, np.int64)), pa.array(add["base"]),
                 pa.array(add["score"])], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    out = sums.repartition(parts_of(spark), "block").mapInArrow(
        finished, "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("id", id_col)
