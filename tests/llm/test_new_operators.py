"""Periodic runs, importance resampling and token files against brute-force versions."""

import hashlib
import io
import math
import random
import re
import zlib

import numpy as np
import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
TOKEN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def prose(n, seed, vocabulary=3000):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


EDGE = [(None, None), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "one two"), (None, "a a a a a a a"),
        (6, "x y x y x y x y"), (6, "x y x y x y x y"), (6, "x Y x y x y x y x y"), (7, "É ü ß  x"), (8, prose(3000, 8)),
        (9, "a\x0ba\x0ca\ta\na\ra"), (10, "f\nf\nf\nf\nf\nf f")]


# --- periodic runs ---

def all_runs(w):
    """every maximal stretch of smallest period q and at least max(6, 4q) words, by trying all starts and periods"""
    n, found = len(w), {}
    for q in range(1, n // 4 + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found.setdefault((i, j - i + q), q)  # smaller periods come first
            i = j + 1
    return sorted((s, n, q) for (s, n), q in found.items())


def rewritten(doc, w):
    h = zlib.crc32(str(doc).encode()) & 0xFFFFFFFF
    n = len(w)
    if doc is None or h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + math.floor((n - a) / (3 + g % 8))
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def run_row(doc, text, plant=True):
    w = WORD.findall(text or "")
    w = rewritten(doc, w) if plant else w
    found = all_runs(w)
    drop = {i for s, n, q in found for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in sorted(found, key=lambda r: (r[0], r[2])))
    best = min(found, key=lambda r: (-r[1], r[0], r[2])) if found else (None, None, None)
    return (doc, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2],
            hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest())


RUN_COLUMNS = ("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")


def as_rows(df, columns):
    return sorted(map(repr, (tuple(r[c] for c in columns) for r in df.collect())))


def test_z_function():
    from contactlift.llm.periodic import z_function

    r = random.Random(1)
    for _ in range(200):
        s = [r.randrange(2) for _ in range(r.randrange(1, 40))]
        want = [0] + [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(1, len(s))]
        assert z_function(s, len(s)) == want


def test_solve_and_hits_find_every_run_of_short_sequences():
    """all binary and ternary sequences of some lengths, and long ones with planted runs, tile by tile without Spark"""
    import itertools

    import pyarrow as pa

    from contactlift.llm import words as W

    texts = [" ".join(s) for n in (6, 8, 11) for s in itertools.product("ab", repeat=n)]
    texts += [" ".join(random.Random(i).choices("abc", k=90)) for i in range(60)]
    check_pieces(W, pa, texts)


def check_pieces(W, pa, texts):
    from contactlift.llm import periodic as P

    schema_batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "key": pa.array(range(len(texts)), pa.int64()),
                                               "text": pa.array(texts)})
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("plain", pa.string()),
                        ("words", pa.binary()), ("octave", pa.int32()), ("cell", pa.int64()), ("at", pa.int64()),
                        ("marks", pa.binary()), ("codes", pa.binary())])
    pieces = {}
    for run in W.runs(schema_batch["text"], cased=True):
        for out in P._of_run(run, schema_batch, None, schema):
            for row in out.to_pylist():
                if row["octave"] is not None:
                    for q, a, b in P._solve(np.frombuffer(row["codes"], "<i4"), np.frombuffer(row["marks"], "<i8"), row["octave"]):
                        pieces.setdefault((row["id"], q), []).append((row["at"] + a, row["at"] + b))
    found = {}
    for (i, q), spans in sorted(pieces.items()):
        end = start = None
        for a, b in sorted(spans) + [(None, None)]:
            if end is not None and a is not None and a <= end:
                end = max(end, b)
                continue
            if end is not None and end - start + q >= max(6, 4 * q):
                found.setdefault(i, {}).setdefault((start, end - start + q), q)
            start, end = a, b
    for i, t in enumerate(texts):
        assert sorted((s, n, q) for (s, n), q in found.get(i, {}).items()) == all_runs(t.split()), t


def test_long_runs_over_many_tiles():
    import pyarrow as pa

    from contactlift.llm import words as W

    r = random.Random(5)
    texts = []
    for p, times in ((1, 20000), (7, 3000), (1000, 9.5), (2500, 4), (2049, 4.2), (513, 20)):
        block = [f"x{r.randrange(10**6)}" for _ in range(p)]
        body = (block * (int(times) + 1))[:int(p * times)]
        texts.append(" ".join([f"a{r.randrange(10**6)}" for _ in range(777)] + body + [f"b{r.randrange(10**6)}" for _ in range(777)]))
    from contactlift.llm import periodic as P

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "key": pa.array(range(len(texts)), pa.int64()),
                                        "text": pa.array(texts)})
    assert batch.num_rows == len(texts) and P.CELL < 20000
    want = [(777, 20000, 1), (777, 21000, 7), (777, 9500, 1000), (777, 10000, 2500), (777, 8605, 2049), (777, 10260, 513)]
    for t, w in zip(texts, want):
        words_ = t.split()
        assert all(words_[i] == words_[i + w[2]] for i in range(w[0], w[0] + w[1] - w[2]))
        check_one(W, pa, t, w)


def check_one(W, pa, text, want):
    from contactlift.llm import periodic as P

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([0], pa.int64()), "key": pa.array([0], pa.int64()), "text": pa.array([text])})
    schema = pa.schema([("id", pa.int64()), ("key", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("plain", pa.string()),
                        ("words", pa.binary()), ("octave", pa.int32()), ("cell", pa.int64()), ("at", pa.int64()),
                        ("marks", pa.binary()), ("codes", pa.binary())])
    spans = []
    for run in W.runs(batch["text"], cased=True):
        for out in P._of_run(run, batch, None, schema):
            for row in out.to_pylist():
                if row["octave"] is not None:
                    spans += [(row["at"] + a, row["at"] + b) for q, a, b in
                              P._solve(np.frombuffer(row["codes"], "<i4"), np.frombuffer(row["marks"], "<i8"), row["octave"]) if q == want[2]]
    spans.sort()
    start, end = spans[0]
    for a, b in spans[1:]:
        assert a <= end
        end = max(end, b)
    assert (start, end - start + want[2]) == want[:2]


def test_run_digests(spark, table):
    from contactlift.llm.periodic import planted, run_digests

    r = random.Random(3)
    rows = list(EDGE)
    for i in range(20, 120):
        rows.append((i, " ".join(r.choices("ab" if i % 3 else "abcd", k=r.randrange(1, 120)))))
    rows += [(i, prose(400, i, 50)) for i in range(200, 240)]
    rows.append((500, "line one two three\n" * 300 + prose(200, 1)))
    docs = table(rows)
    assert as_rows(run_digests(docs, planted), RUN_COLUMNS) == sorted(repr(run_row(d, t)) for d, t in rows)
    assert as_rows(run_digests(docs), RUN_COLUMNS) == sorted(repr(run_row(d, t, False)) for d, t in rows)


def test_run_digests_of_an_empty_table(spark, table):
    from contactlift.llm.periodic import planted, run_digests

    assert run_digests(table([(1, "x")]).where("doc_id < 0"), planted).collect() == []


def test_op11_on_the_given_table(spark):
    from contactlift.llm.queries import QUERIES, table as given

    sf = "/root/testdata/sf0.001"
    got = as_rows(QUERIES["op11_periodic_runs"](spark, sf), RUN_COLUMNS)
    rows = [(r["doc_id"], r["text"]) for r in given(spark, sf, "documents").select("doc_id", "text").collect()]
    short = [(d, t) for d, t in rows if len((t or "").split()) < 3000]
    want = {repr(run_row(d, t)) for d, t in short}
    assert want <= set(got) and len(got) == len(rows)


# --- importance resampling ---

def features(t):
    w = TOKEN.findall(low(t))
    return w, w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def resampled(rows, target, percent=25, least=20, seed=7):
    def buckets(t):
        return [zlib.crc32(f.encode()) % 10000 for f in features(t)[1]]

    s, t = [0] * 10000, [0] * 10000
    for _, x in rows:
        for b in buckets(x):
            s[b] += 1
    for x in target:
        for b in buckets(x):
            t[b] += 1
    S, T = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (S + 10000) / ((s[b] + 1) * (T + 10000)))) for b in range(10000)]
    out = []
    for d, x in rows:
        f = buckets(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if d is None else d}".encode()).hexdigest()[:8], 16)
        out.append([d, len(features(x)[0]), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    for i, r in enumerate(fit[:percent * len(fit) // 100]):
        r[5] = i + 1
    return [tuple(r) for r in out]


RANK_COLUMNS = ("doc_id", "n_words", "n_features", "weight", "score", "rank")


def test_features_of_pieces(monkeypatch):
    from contactlift.llm import resample as R

    r = random.Random(2)
    texts = ["".join(r.choices("aB é9\n-_\x00", k=r.randrange(0, 60))) for _ in range(300)] + [None, "", "x" * 50]
    for size in (1, 3, 7, 1 << 20):
        monkeypatch.setattr(R, "PIECE", size)
        for t in texts:
            parts = list(R.features(None if t is None else t.encode()))
            assert sum(n for n, _ in parts) == len(features(t)[0])
            assert sorted(c for _, p in parts for c in p) == sorted(zlib.crc32(f.encode()) for f in features(t)[1])


def test_resample(spark, table):
    from contactlift.llm.resample import resample

    rows = EDGE + [(i, prose(15 + i % 40, i % 60, 200)) for i in range(100, 700)] + [(None, prose(30, 3, 200)), (900, None)]
    target = [prose(60, 1000 + i, 100) for i in range(30)] + [None, ""]
    docs = table(rows, parts=5)
    goal = spark.createDataFrame([(t, 1) for t in target], "text string, score int")
    got = as_rows(resample(docs, goal), RANK_COLUMNS)
    assert got == sorted(map(repr, resampled(rows, target)))


def test_rank_of_ties_and_repeated_rows(spark):
    from contactlift.llm.resample import ranked

    rows = [(i % 50 if i % 7 else None, (i * i) % 3) for i in range(2000)]  # three scores, each id many times
    df = spark.createDataFrame(rows, "doc_id long, score long").repartition(7)
    got = [(r["rank"], r["score"], r["doc_id"]) for r in ranked(df).collect()]
    want = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))
    assert [(s, d) for _, s, d in sorted(got, key=lambda r: r[0])] == [(s, d) for d, s in want]
    assert sorted(r for r, _, _ in got) == list(range(1, 2001))


def test_rank_where_small_runs_are_read_together(spark, tmp_path):
    """Runs of very different sizes: Spark packs the small files into one task, whose batches then hold several runs."""
    from contactlift.llm.resample import ranked

    docs = spark.range(0, 24000, 1, 8).selectExpr("id as doc_id", "(id * 7919) % 5003 - 2500 as score", "id < 6000 or id % 3000 < 40 as fit")
    docs.write.parquet(str(tmp_path / "docs"))
    df = spark.read.parquet(str(tmp_path / "docs")).where("fit")
    got = sorted((r["rank"], -r["score"], r["doc_id"]) for r in ranked(df).collect())
    assert got == [(i, *r) for i, r in enumerate(sorted((-r["score"], r["doc_id"]) for r in df.collect()), 1)]


def test_resample_of_empty_tables(spark, table):
    from contactlift.llm.resample import resample

    docs = table([(i, prose(30, i)) for i in range(20)])
    none = spark.createDataFrame([], "text string")
    assert resample(docs.where("doc_id < 0"), docs).collect() == []
    assert as_rows(resample(docs, none), RANK_COLUMNS) == sorted(map(repr, resampled([(i, prose(30, i)) for i in range(20)], [])))


# --- token files ---

def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


ODD = ["Hello  World's\tdon't 'S", "é ́x á̧", "<|endoftext|> a<|startoftext|>b <|endoftext |>", "İΣ ΣΣ ẞﬁ",
       "a b c\u0085d\x1ce\x00f", "12 345٣ 大阪 日本語 ไทย", "\U0001f600‍\U0001f468 x​y", "각 ᅡ", "a\x0bb\x0cc\r\nd",
       "x" * 300, "ÅΩ   "]


def test_ids_are_those_of_the_whole_text(spark, table):
    from tokenizers import Tokenizer

    from contactlift.llm.tokens import encode

    whole = Tokenizer.from_file(tokenizer_path())
    rows = [(i, t) for i, t in enumerate(ODD)] + EDGE + [(50, prose(20000, 4, 10**5))]
    got = sorted((repr(r["doc_id"]), np.frombuffer(r["ids"], "<u4").tolist()) for r in encode(table(rows), tokenizer_path(), 1).collect())
    assert got == sorted((repr(d), whole.encode(t or "", add_special_tokens=False).ids + [1]) for d, t in rows)


def test_token_files_round_trip(spark, table, tmp_path):
    from tokenizers import Tokenizer

    from contactlift.llm import tokens as T

    rows = EDGE + [(1000 - i, prose(20 + i, i, 500)) for i in range(400)] + [(5, "again"), (-3, "minus")]
    whole = Tokenizer.from_file(tokenizer_path())
    docs, path = table(rows, parts=4), str(tmp_path / "files")
    got = T.token_digests(docs, tokenizer_path(), 1, path).collect()
    ids = {(d, t): whole.encode(t or "", add_special_tokens=False).ids + [1] for d, t in rows}
    assert sorted((repr(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(
        (repr(d), len(ids[d, t]), zlib.crc32(np.array(ids[d, t], "<u4").tobytes())) for d, t in rows)
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda d: (d is not None, d or 0))

    raw = T.read_dictionary(spark, path)
    assert raw
    seen = 0
    for file in sorted((tmp_path / "files" / "files").glob("part-*")):
        with open(file, "rb") as f:
            one = T.TokenFile(f, raw)
            for doc in {int(d) for d, k in zip(one.index["doc_id"], one.index["known"]) if k}:
                mine = [x.tolist() for x in one.ids(doc)]
                seen += len(mine)
                assert sorted(mine) == sorted(ids[d, t] for d, t in rows if d == doc)
            seen += len(one.ids(None))
            with pytest.raises(ValueError):
                T.TokenFile(io.BytesIO(file.read_bytes()), raw + b"x")
    assert seen == len(rows)


def test_token_files_of_an_empty_table_and_few_rows(spark, table):
    from contactlift.llm import tokens as T

    few = table([(3, "a b"), (1, None)])
    assert T.token_digests(few.where("doc_id < 0"), tokenizer_path()).collect() == []
    got = sorted(tuple(r) for r in T.token_digests(few, tokenizer_path()).select("doc_id", "start", "n_tokens").collect())
    assert got == [(1, 0, 1), (3, 1, 3)]


def test_wide_ids_round_trip():
    from contactlift.llm import tokens as T

    ids = np.array([0, 1, 70000, 2**32 - 1], "<u4").tobytes()
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([4], pa.int64()), "ids": pa.array([ids], pa.binary())})
    blob = b"".join(x.as_py() + b"\n" for b in T._records([batch], 4, b"") for x in b["record"])
    assert T.TokenFile(io.BytesIO(blob), b"").ids(4)[0].tobytes() == ids


# --- repeated passages whose seeds have different first documents ---

def quoted(n_quotes, size, seed):
    r = random.Random(seed)
    body = [f"p{r.randrange(10**6)}" for _ in range(60)]
    quotes = []
    for i in range(n_quotes):
        at = round(i * (60 - size) / (n_quotes - 1))
        quotes.append(" ".join([f"q{i}x{j}" for j in range(30)] + body[at:at + size] + [f"q{i}y{j}" for j in range(30)]))
    whole = [" ".join([f"{c}{j}" for j in range(40)] + body + [f"{c}z{j}" for j in range(40)]) for c in "ab"]
    return quotes, whole


@pytest.mark.parametrize("n_quotes", [7, 42])
@pytest.mark.parametrize("place", ["after", "before", "among"])
def test_passages_quoted_in_pieces(spark, table, n_quotes, place):
    from contactlift.llm.chains import repeated_passages

    quotes, whole = quoted(n_quotes, 19, n_quotes)
    order = {"after": quotes + whole, "before": whole + quotes, "among": [whole[0], *quotes, whole[1]]}[place]
    got = repeated_passages(table(list(enumerate(order)), parts=1 if place == "after" else 3)).collect()
    both = {order.index(w) for w in whole}
    assert {r["doc_id"] for r in got} == both
    assert all(r["first_word"] <= 40 + 8 and r["first_word"] + r["n_words"] >= 100 - 8 for r in got)


def test_shared_pieces_against_all_pairs(spark, table):
    from contactlift.llm.chains import repeated_passages

    r = random.Random(77)
    pool = [[f"p{i}x{r.randrange(10**6)}" for _ in range(r.randrange(50, 120))] for i in range(25)]
    docs = []
    for d in range(70):
        text = []
        for _ in range(r.randrange(1, 5)):
            text += [f"d{d}u{r.randrange(10**6)}" for _ in range(r.randrange(30, 60))]
            piece = r.choice(pool)
            a = r.choice([0, 0, r.randrange(0, len(piece) - 18)])
            text += piece[a:] if a == 0 else piece[a:a + r.choice([18, 25])]
        docs.append(text + [f"d{d}end"])
    grams: dict = {}
    for d, t in enumerate(docs):
        for i in range(len(t) - 49):
            grams.setdefault(tuple(t[i:i + 50]), set()).add(d)
    want = {(d, i + j) for d, t in enumerate(docs) for i in range(len(t) - 49) if len(grams[tuple(t[i:i + 50])]) > 1 for j in range(50)}
    got = repeated_passages(table([(d, " ".join(t)) for d, t in enumerate(docs)])).collect()
    found = {(x["doc_id"], i) for x in got for i in range(x["first_word"], x["first_word"] + x["n_words"])}
    assert want <= found and len(found - want) <= 8 * len(got)


# --- wrapped notices, articles that near copies repeat, long runs ---

NOTICES = {
    "mit": "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated "
           "documentation files (the \"Software\"), to deal\nin the Software without restriction",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following "
           "conditions\nare met",
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as "
           "published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "apache-2.0": "Licensed under the Apache License,\nVersion 2.0 (the \"License\"); you may not use this\nfile except in compliance"}


def test_wrapped_notices(spark, table):
    from contactlift.llm.licenses import scan

    rows = [(i, f"{prose(30, i)}\n\n{t}\n\n{prose(30, i + 50)}") for i, t in enumerate(NOTICES.values())]
    rows += [(10, "MIT License"), (11, "the license was lent with us\nthe reserved\n\nwords"), (12, NOTICES["gpl"].replace("\n", "\n\n"))]
    rows += [(100 + i, prose(40, i) + "\n" + prose(30, 1000 + i)) for i in range(60)]
    got = scan(table(rows)).collect()
    assert {(r["doc_id"], r["family"]) for r in got} == {(i, f) for i, f in enumerate(NOTICES)} | {(10, "mit")}
    assert sum(r["doc_id"] in (1, 2, 3) for r in got) == 3  # each once


def test_equal_blocks_of_an_article_stay():
    from contactlift.llm.wrapper import main_text

    def page(x, menu):
        return (f"<html><body>{menu}<article><h1>T</h1><p>para {x}</p><ul><li>one</li><li>two</li></ul><table><tr><td>a</td><td>b</td></tr></table>"
                f"</article><div class='z'>same for all</div></body></html>")

    deep = "<div class='q'>" * 200 + "<span>home about</span>" + "</div>" * 200
    for menu in ("", deep):
        assert main_text(page("one", menu), [page("two", menu)]).split("\n") == ["T", "para one", "one", "two", "a", "b"] or \
            main_text(page("one", menu), [page("two", menu)]).replace("\n", " ").split() == "T para one one two a b".split()


def test_deep_constant_menus_are_template():
    from contactlift.llm.wrapper import main_text

    def page(x):
        menu = "<div>" * 150 + "<i>home about</i>" + "</div>" * 150
        return f"<body>{menu}<div><p>{x}</p><p>more {x}</p></div></body>"

    assert "home" not in main_text(page("a " * 50), [page("b " * 50)])


def test_hard_texts_scan_in_linear_time():
    import time

    from contactlift.llm.pii import _found
    from contactlift.llm.wrapper import main_text, parse

    n = 1_000_000
    for hard in ("a1" * (n // 2), "(" * n, "1." * (n // 2), " (" * (n // 2), "a@" * (n // 2), "+" * n, "a(at)b" * (n // 6), "1@b.c " * (n // 60)):
        t = time.time()
        _found(hard)
        assert time.time() - t < 20, hard[:10]
    for hard in ("<a " * (n // 3), "<a " * (n // 3) + ">", "<" * n, "<!-- " * (n // 5), "<script " * (n // 8), "<p>x" * 20000):
        t = time.time()
        parse(hard)
        assert time.time() - t < 20, hard[:10]
    assert main_text("<p>a<script>var x = 1; if (a > b) c", []) == "a" and main_text("<p>a</p>tail", []) == "a\ntail"
    assert main_text("<p>a<!-- open > b", []) == "a" and main_text("<p>x</p>y <!-- open", []) == "x\ny"


def test_identifier_like_strings():
    from contactlift.llm.pii import like_spans

    like = re.compile(r"[0-9(][0-9().:/\x20-]{4,}[0-9]|[A-Za-z0-9._%+-]+(?:@|\(at\)|\[at\])[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*")
    for t in ("call (030) 123-4567 or 555 1234.", "a.b(at)c.de x[at]y 1.2.3.4", "no 12345 here", "123456", "(1 2) 3 4/5 (", "x@y.z, u@v",
              "é (12) 34 56 é", "12:34:56 a@b"):
        assert like_spans(t) == [m.span() for m in like.finditer(t)], t


# --- budgets ---

def test_shares_of_sizes_at_every_budget():
    from contactlift.llm.mixing import fit_counts

    cases = [(np.array([5, 200]), np.array([150, 150]), 23062)]
    r = np.random.default_rng(3)
    for scale in (10**3, 10**5, 10**7):
        sizes = np.unique(np.maximum(1, r.lognormal(4.5, 1.2, 3000).astype(np.int64)))
        counts = r.integers(1, 1 + max(1, 2 * scale // int(sizes.sum())), len(sizes))
        cases += [(sizes, counts, int((sizes * counts).sum() * f)) for f in (0.1, 0.5, 0.93)]
    cases.append((np.array([1, 7, 100_000_000]), np.array([50, 50, 3]), 210_000_123))
    for sizes, counts, budget in cases:
        take = fit_counts(sizes, counts, budget)
        assert (take >= 0).all() and (take <= counts).all()
        if sizes.max() < 10**6:
            assert abs(int((take * sizes).sum()) - budget) <= np.gcd.reduce(sizes) / 2
            share = budget / int((sizes * counts).sum())
            for lo, hi in ((0, 50), (50, 200), (200, 10**9)):
                own = (sizes >= lo) & (sizes < hi)
                if (words := int((sizes * counts)[own].sum())) > 3000:
                    assert abs(int((take * sizes)[own].sum()) / words - share) < 0.1
            part = [(x * sizes)[sizes >= 200].sum() / (x * sizes).sum() for x in (take, counts)]
            assert abs(part[0] - part[1]) < 0.05 + int(sizes.max()) / budget  # documents are not cut
        else:
            assert abs(int((take * sizes).sum()) - budget) < 10**8


@pytest.mark.parametrize("place", ["after", "before", "among"])
def test_passages_quoted_but_for_a_word(spark, table, place):
    """Two documents share 50 words, of which others quote 49: each seed occurs first in a quote, each quote is too short."""
    from contactlift.llm.chains import repeated_passages

    for n, size, seed in ((2, 49, 1), (5, 46, 2), (18, 33, 3)):
        r = random.Random(seed)
        body = [f"p{r.randrange(10**6)}" for _ in range(50)]
        quotes = [" ".join([f"q{seed}x{i}x{j}" for j in range(30)] + body[at:at + size] + [f"q{seed}y{i}y{j}" for j in range(30)])
                  for i, at in enumerate(round(i * (50 - size) / (n - 1)) for i in range(n))]
        whole = [" ".join([f"{c}{j}" for j in range(40)] + body + [f"{c}z{j}" for j in range(40)]) for c in "ab"]
        order = {"after": quotes + whole, "before": whole + quotes, "among": [whole[0], *quotes, whole[1]]}[place]
        got = repeated_passages(table(list(enumerate(order)), parts=1 if place == "after" else 3)).collect()
        assert {(x["doc_id"], x["first_word"], x["n_words"]) for x in got} == {(order.index(w), 40, 50) for w in whole}


@pytest.mark.parametrize("seed", [1, 2])
def test_runs_of_fifty_words_against_all_pairs(spark, table, seed):
    """Every 50 words in a row that two documents share are part of a passage, whatever pieces of them others quote."""
    from contactlift.llm.chains import repeated_passages

    r = random.Random(seed)
    pool = [[f"p{i}x{r.randrange(10**6)}" for _ in range(r.randrange(50, 64))] for i in range(4)]
    docs = []
    for d in range(150):
        text = []
        for _ in range(r.randrange(1, 4)):
            text += [f"d{d}u{r.randrange(10**6)}" for _ in range(r.randrange(45, 60))]
            piece = r.choice(pool)
            n = r.choice([*range(33, 50), 50, 50, 50, 51, 55])
            a = r.randrange(0, max(1, len(piece) - n + 1))
            text += piece[a:a + n]
        docs.append(text + [f"d{d}end"])
    grams: dict = {}
    for d, t in enumerate(docs):
        for i in range(len(t) - 49):
            grams.setdefault(tuple(t[i:i + 50]), set()).add(d)
    want = {(d, i + j) for d, t in enumerate(docs) for i in range(len(t) - 49) if len(grams[tuple(t[i:i + 50])]) > 1 for j in range(50)}
    got = repeated_passages(table([(d, " ".join(t)) for d, t in enumerate(docs)])).collect()
    assert want <= {(x["doc_id"], i) for x in got for i in range(x["first_word"], x["first_word"] + x["n_words"])}


def test_passages_with_other_words_between(spark, table):
    """Two passages in the same order, 30 other words apart: the chain through both has too few equal words."""
    from contactlift.llm.chains import repeated_passages

    r = random.Random(4)
    one, two = ([f"{c}{r.randrange(10**6)}" for _ in range(50)] for c in "pq")
    docs = [" ".join(one + [f"{c}{j}" for j in range(30)] + two) for c in "ab"]
    got = repeated_passages(table(list(enumerate(docs)))).collect()
    assert {(x["doc_id"], x["first_word"], x["n_words"]) for x in got} == {(d, at, 50) for d in (0, 1) for at in (0, 80)}


def test_equal_runs():
    from contactlift.llm.chains import _equal_runs

    x, y = np.arange(100, dtype=np.uint32), np.arange(200, 300, dtype=np.uint32)
    assert _equal_runs(x, y, 20) == []
    y[10:35], y[40:59] = x[50:75], x[0:19]
    assert _equal_runs(x, y, 20) == [(50, 10, 25)]
    assert sorted(_equal_runs(x, np.concatenate([x[:20], y[:5], x[:30]]), 20)) == [(0, 0, 20), (1, 26, 29)]


def test_minimizers_of_several_texts():
    from contactlift.llm import words as W
    from contactlift.llm.chains import minimizers

    r = np.random.default_rng(5)
    for window in (1, 3, 12):
        sizes = [0, 3, 8, 9, 19, 20, 0, 60, 200, 0]
        h = r.integers(0, 4, sum(sizes)).astype(np.uint64)  # few words, so hashes repeat
        first = np.concatenate([[0], np.cumsum(sizes)])
        want = set()
        for a, b in zip(first[:-1], first[1:]):
            g = W.shingles(h[a:b], 8)
            windows = range(max(1, len(g) - window + 1)) if len(g) else ()
            want |= {int(a) + i + int(np.argmin(g[i:i + window])) for i in windows}
        assert minimizers(h, first, 8, window)[1].tolist() == sorted(want)
