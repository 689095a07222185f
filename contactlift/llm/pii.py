"""Personal data by bootstrapped contextual extraction.

Base entities (emails, IP addresses, payment cards, phone numbers) are found by fixed expressions and are the seeds.
The two words before a seed are a lexical pattern of its kind. Spark scores the graph of patterns and of the
identifier-like strings they precede: a pattern's score is the mean confidence of its distinct instances, an
instance's confidence is the chance that one of its patterns is right. After a few rounds, patterns with enough
distinct supporters and a high score admit the unseen identifiers of a fitting shape that follow them.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from itertools import accumulate
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactlift.llm.store import fresh, written

KINDS = ("email", "ip", "card", "phone")
ROUNDS = 3
MIN_SUPPORT = 5
MIN_SCORE = 0.8

# The base expressions. Each is written so that it scans in linear time and finds the same leftmost,
# non-overlapping matches as its plain form: a digit run is entered at its start only and never given back.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
# Identifier-like strings, by run: each run is entered once, so scanning is linear for any text.
_NUMBER = re.compile(r"[0-9().:/\x20-]{6,}+")
_NUMBER_START = re.compile(r"[0-9(]")
_MAIL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:@|\(at\)|\[at\])[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+")
_BEFORE = re.compile(r"[^\x20\x09-\x0D]+")
# A context is two whole words; a word of more characters than this is no part of one.
_CONTEXT_WORD = 256


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def base_spans(t: str) -> list[tuple[str, int, int]]:
    """Base entities of a text, by kind as in ``KINDS``, then by start."""
    out = []
    done, at = 0, t.find("@")
    while at >= 0:
        a = at
        while a > done and t[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(t, at + 1) if a < at else None
        if m:
            out.append(("email", a, m.end()))
            done = m.end()
        at = t.find("@", max(at + 1, done))
    if not _DIGIT.search(t):
        return out
    for m in _IP.finditer(t):
        if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(t):
        d = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(d) <= 19 and _luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 8 <= sum(c.isdigit() for c in m[0]) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def _fits(s: str) -> list[str]:
    """Kinds whose shape an identifier-like string has."""
    if "@" in s or "at)" in s or "at]" in s:
        return ["email"]
    n = sum(c.isdigit() for c in s)
    kinds = []
    if s.count(".") == 3 and re.fullmatch(r"[0-9.]+", s):
        kinds.append("ip")
    if 12 <= n <= 19:
        kinds.append("card")
    if 7 <= n <= 15:
        kinds.append("phone")
    return kinds


def _context(t: str, at: int) -> str | None:
    size, most = 80, 2 * (_CONTEXT_WORD + 1) + 64
    while True:
        w = [m for m in _BEFORE.finditer(t, max(0, at - size), at)][-2:]
        if len(w) == 2 and (w[0].start() > at - size or at <= size):
            words = [m[0].lower() for m in w]
            return None if max(map(len, words)) > _CONTEXT_WORD else " ".join(words)
        if at <= size or size >= most:
            return None
        size = most


def like_spans(t: str) -> list[tuple[int, int]]:
    """Identifier-like strings of a text, leftmost first and not overlapping: from a digit or opening bracket to the last digit
    of a run of digits and their marks (six characters at least), and words that an at sign joins, in whatever spelling."""
    found = []
    for m in _NUMBER.finditer(t):
        a = _NUMBER_START.search(t, m.start(), m.end())
        end = m.end()
        while a and end > a.end() and not t[end - 1].isdigit():
            end -= 1
        if a and end - a.start() >= 6:
            found.append((a.start(), end))
    found += [m.span() for m in _MAIL.finditer(t)]
    out, done = [], 0
    for a, b in sorted(found, key=lambda s: s[0]):
        if a >= done:
            out.append((a, b))
            done = b
    return out


def _found(t: str) -> list[dict]:
    """Base spans and identifier-like strings outside them, with their contexts."""
    base = base_spans(t)
    out = [{"kind": k, "start": a, "end": b, "base": True, "context": _context(t, a), "instance": t[a:b].lower()}
           for k, a, b in base]
    if base or _DIGIT.search(t) or "@" in t or "at" in t:
        taken = sorted((a, b) for _, a, b in base)
        starts = [a for a, _ in taken]
        ends = list(accumulate((b for _, b in taken), max))
        for a, b in like_spans(t):
            before = bisect_left(starts, b)
            if before and ends[before - 1] > a:  # overlaps a base span
                continue
            if c := _context(t, a):
                out += [{"kind": k, "start": a, "end": b, "base": False, "context": c, "instance": t[a:b].lower()} for k in _fits(t[a:b])]
    return out


_FOUND = "array<struct<kind:string,start:long,end:long,base:boolean,context:string,instance:string>>"


def accepted_patterns(found: DataFrame, rounds: int = ROUNDS, min_support: int = MIN_SUPPORT,
                      min_score: float = MIN_SCORE) -> DataFrame:
    """(kind, context, score) of the trusted patterns, from rows (kind, context, instance, base)."""
    pairs = written(found.where("context IS NOT NULL").groupBy("kind", "context", "instance")
                    .agg(F.max("base").alias("seed")), "graph")
    belief = pairs.groupBy("kind", "instance").agg(F.max("seed").cast("double").alias("belief"))
    score = None
    for _ in range(rounds):
        score = (pairs.join(belief, ["kind", "instance"]).groupBy("kind", "context")
                 .agg(F.avg("belief").alias("score"), F.sum((F.col("belief") >= 0.5).cast("long")).alias("support"))
                 .where(F.col("support") >= min_support))
        score = written(score, "patterns")
        right = F.coalesce(F.col("score"), F.lit(0.0))
        belief = (pairs.join(score, ["kind", "context"], "left").groupBy("kind", "instance")
                  .agg(F.greatest(F.max("seed").cast("double"),
                                  1 - F.exp(F.sum(F.log(F.greatest(1 - right, F.lit(1e-9)))))).alias("belief")))
        belief = written(belief, "beliefs")
    return score.where(F.col("score") >= min_score).select("kind", "context", "score")


def personal_data(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rounds: int = ROUNDS,
                  min_support: int = MIN_SUPPORT, min_score: float = MIN_SCORE) -> DataFrame:
    """One row per row of ``docs``: (id_col, spans array<struct<kind, start, end, base>>), sorted by kind, then start.

    Offsets are code points, the end exclusive. A null text is empty and has no spans. Equal rows get equal results;
    ids may be null; extra columns are ignored; an empty table gives an empty result.
    """
    def task(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([_found(t) if t else [] for t in b.column(1).to_pylist()], kind)], ["id", "found"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    id_type = docs.schema[id_col].dataType.simpleString()
    kind = to_arrow_type(_parse_datatype_string(_FOUND))
    rows = docs.select(F.col(id_col).alias("id"), text).mapInArrow(task, f"id {id_type}, found {_FOUND}")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "found")  # fixed by being written
    flat = rows.where(F.size("found") > 0).select("row", F.inline("found"))
    good = accepted_patterns(flat, rounds, min_support, min_score)
    more = (flat.where(~F.col("base")).join(good, ["kind", "context"]).select("row", "kind", "start", "end")
            .groupBy("row").agg(F.collect_set(F.struct("kind", "start", "end", F.lit(False).alias("base"))).alias("more")))
    order = F.expr("array_sort(all, (x, y) -> CASE WHEN " + _rank("x") + " <> " + _rank("y") + " THEN "
                   + _rank("x") + " - " + _rank("y") + " WHEN x.start < y.start THEN -1 WHEN x.start > y.start THEN 1 ELSE 0 END)")
    base = F.transform(F.filter("found", lambda x: x["base"]),
                       lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"), x["base"].alias("base")))
    out = rows.join(more, "row", "left").select(
        "id", F.when(F.col("more").isNull(), base).otherwise(F.concat(base, "more")).alias("all"))
    return out.select(F.col("id").alias(id_col), order.alias("spans"))


def _rank(x: str) -> str:
    return f"CASE {x}.kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(KINDS)) + " END"


def redacted(docs: DataFrame, key: str, text: str = "text", **parameters) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets; overlapping spans count as one. ``key`` is a
    column that differs between rows."""
    spans = personal_data(docs, key, text, **parameters).where(F.size("spans") > 0)
    k, c = fresh(docs, "_key"), fresh(docs, "_spans")
    cut = spans.select(F.col(key).alias(k), F.expr("array_sort(transform(spans, x -> struct(x.start, x.end, x.kind)))").alias(c))
    joined = docs.join(cut, docs[key] == F.col(k), "left").drop(k)
    # fold from the left: text so far, position; a span that begins before the position only moves the position
    fold = F.expr(f"""aggregate(`{c}`, named_struct('o', '', 'p', 0L),
        (a, x) -> if(x.start >= a.p, named_struct('o', concat(a.o, substring(`{text}`, cast(a.p + 1 AS int), cast(x.start - a.p AS int)),
            '[', upper(x.kind), ']'), 'p', x.end), named_struct('o', a.o, 'p', greatest(a.p, x.end))),
        a -> concat(a.o, substring(`{text}`, cast(a.p + 1 AS int))))""")
    return joined.withColumn(text, F.when(F.col(c).isNull(), F.col(text)).otherwise(fold)).drop(c)


def digest_columns(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of ``personal_data``'s spans."""
    def listed(c: str) -> str:
        return f"array_join(transform({c}, x -> concat(x.kind, ':', x.start, ':', x.end)), ',')"

    out = found.withColumn("b", F.expr("filter(spans, x -> x.base)"))
    return out.select(id_col, *[F.expr(f"cast(size(filter(b, x -> x.kind = '{k}')) AS long)").alias(f"n_{k}") for k in KINDS],
                      F.sha2(F.expr(listed("b")), 256).alias("base_sha256"), F.expr(listed("spans")).alias("spans"))


def base_digest(t: str) -> str:
    """``base_sha256`` of one text."""
    return sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base_spans(t)).encode()).hexdigest()
