"""DuckDB SQL of the operators whose whole result SQL can express, on whole tables. Written from the contracts, not from the
operators' methods: plain joins and windows where the operators use digests, signatures, tiles or sorted runs."""

from __future__ import annotations

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"


def lowered(text: str) -> str:
    return f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"


# CRC-32 of a text's UTF-8 bytes: the table of 256 remainders, and one step per byte.
CRC_TABLE = """steps AS (SELECT n::bigint AS n, n::bigint AS c, 0 AS k FROM range(256) t(n)
    UNION ALL SELECT n, xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), k + 1 FROM steps WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY n) AS tab FROM steps WHERE k = 8)"""


def crc32(bytes_of: str) -> str:
    """Of an expression for a VARCHAR, in a query that also reads ``crc_table``."""
    codes = f"list_transform(range(0, octet_length(encode({bytes_of}))), lambda i: ('0x' || substr(hex(encode({bytes_of})), 2 * i + 1, 2))::bigint)"
    return f"""xor(list_reduce(list_prepend(4294967295::bigint, {codes}),
        lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295)"""


def _entries(name: str, entries: list[tuple[str, str]]) -> str:
    rows = ", ".join("('" + e + "', '" + e[:e.find("/")] + "', '" + e[e.find("/"):] + f"', '{a}')" for e, a in entries)
    return f"{name}(entry, of_host, starts, action) AS (VALUES {rows})"


def url_filter(rules: list[tuple[str, str]], blocklist: list[str]) -> str:
    fits = "(host = of_host OR ends_with(host, '.' || of_host)) AND starts_with(path, starts)"
    return rf"""WITH {_entries('rules', rules)}, {_entries('blocked', [(e, 'block') for e in blocklist])},
parts AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
split AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
found AS (SELECT page_id, host, path,
    (SELECT max_by(entry, length(entry)) FROM rules WHERE {fits}) AS rule,
    (SELECT max_by(action, length(entry)) FROM rules WHERE {fits}) AS action,
    (SELECT max_by(entry, length(entry)) FROM blocked WHERE {fits}) AS listed FROM split)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN listed IS NULL THEN 'allow' ELSE 'block' END) AS verdict, listed
FROM found"""


def near_duplicates(k: int = 5, percent: int = 80) -> str:
    return f"""WITH RECURSIVE words AS MATERIALIZED (SELECT doc_id, {WORDS.format(t=lowered('text'))} AS w FROM documents),
shingles AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {k} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {k - 2}), lambda i: array_to_string(w[i:i + {k - 1}], ' ')) END)) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
numbered AS MATERIALIZED (SELECT doc_id, n, hash(s) AS h, s FROM shingles JOIN sizes USING (doc_id)),
links AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b FROM numbered a JOIN numbered b ON a.s = b.s AND a.doc_id <> b.doc_id
    WHERE 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
reached AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reached.doc_id, links.b FROM reached JOIN links ON links.a = reached.r)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id FROM documents d
JOIN (SELECT doc_id, min(r) AS component_id FROM reached GROUP BY doc_id) c USING (doc_id) LEFT JOIN sizes USING (doc_id)"""


def periodic_runs(least: int = 6, times: int = 4) -> str:
    digits = crc32("doc_id::varchar")
    return f"""WITH RECURSIVE {CRC_TABLE},
plain AS MATERIALIZED (SELECT doc_id, {WORDS.format(t="coalesce(text, '')")} AS w, {digits} AS h FROM documents, crc_table),
put AS (SELECT doc_id, w, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, h // 10 AS g FROM plain),
stretch AS (SELECT *, CASE WHEN planted THEN g % n ELSE n END AS a FROM put),
period AS (SELECT *, 1 + (n - a) // (3 + g % 8) AS p FROM stretch),
texts AS MATERIALIZED (SELECT doc_id, n, list_transform(range(0, n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % p END]) AS w FROM period),
words AS MATERIALIZED (SELECT doc_id, n, unnest(range(0, n)) AS i, unnest(w) AS x FROM texts),
-- places whose word comes again q words later; neighbours are one stretch, of their number and q words
equal AS (SELECT a.doc_id, b.i - a.i AS q, a.i FROM words a JOIN words b ON a.doc_id = b.doc_id AND a.x = b.x AND b.i > a.i
    AND {times} * (b.i - a.i) <= a.n),
islands AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS island FROM equal),
periodic AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM islands GROUP BY doc_id, q, island),
runs AS MATERIALIZED (SELECT doc_id, start, length, min(q) AS period FROM periodic WHERE length >= greatest({least}, {times} * q)
    GROUP BY doc_id, start, length),
best AS (SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(start, length, period), (-length, start, period)) AS r,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(x, ' ' ORDER BY i) AS left_over FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, r.start AS start, r.length AS length, r.period AS period,
    1000 * r.length // r.period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256,
    sha256(coalesce(left_over, '')) AS collapsed_sha256
FROM documents LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)"""


def importance_resampling(percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = 10000) -> str:
    words = rf"regexp_extract_all({lowered('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return f"""WITH RECURSIVE {CRC_TABLE},
docs AS MATERIALIZED (SELECT doc_id, {words} AS w FROM documents),
target AS MATERIALIZED (SELECT {words} AS w FROM benchmark),
own AS MATERIALIZED (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM docs),
theirs AS MATERIALIZED (SELECT unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM target),
codes AS MATERIALIZED (SELECT f, {crc32('f')} % {buckets} AS b FROM (SELECT f FROM own UNION SELECT f FROM theirs), crc_table),
counts AS (SELECT b, sum(s) AS s, sum(t) AS t FROM codes JOIN (SELECT f, sum(s) AS s, sum(t) AS t FROM (
    SELECT f, count(*) AS s, 0 AS t FROM own GROUP BY f UNION ALL SELECT f, 0, count(*) FROM theirs GROUP BY f) GROUP BY f) USING (f) GROUP BY b),
gains AS (SELECT b, floor(1000 * ln(((t + 1) * (sum(s) OVER () + {buckets}))::double / ((s + 1) * (sum(t) OVER () + {buckets}))::double))::bigint AS gain
    FROM counts),
weights AS (SELECT doc_id, count(*) AS n_features, floor(sum(gain)::double / count(*))::bigint AS weight
    FROM own JOIN codes USING (f) JOIN gains USING (b) GROUP BY doc_id),
scored AS (SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    ('0x' || substr(sha256('{seed}:' || doc_id), 1, 8))::bigint AS h FROM docs LEFT JOIN weights USING (doc_id)),
drawn AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296::double)))::bigint AS score FROM scored),
ordered AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {least_words} ORDER BY score DESC, doc_id) AS place,
    count(*) OVER (PARTITION BY n_words >= {least_words}) AS fit FROM drawn)
SELECT doc_id, n_words, n_features, weight, score,
    CASE WHEN n_words >= {least_words} AND place <= {percent} * fit // 100 THEN place END AS rank FROM ordered"""
