"""URL filter over a sorted digest array.

A list entry is ``host/path-prefix`` with an action; it fits its host and all subdomains, for urls whose path starts
with the prefix. Entries are kept as a sorted array of 64-bit xxhash digests beside their full strings. Each task
writes the array to a file of its own temporary folder once, memory-maps it, and probes it with a vectorised binary
search: for each url, all host suffixes joined with all path prefixes of a length that occurs in the list. A digest
that is found counts only if the stored string is equal. The longest entry that fits wins.
"""

from __future__ import annotations

import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes of list strings in one broadcast; a longer list is probed in blocks, one after another.
BLOCK_BYTES = 128 << 20
_maps: dict[str, np.ndarray] = {}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): host after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path from there
    up to ``?``, ``#`` or the end. Both empty for null or without ``://``."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = url[at + 3:]
    ends = [x for x in (rest.find("?"), rest.find("#")) if x >= 0]
    rest = rest[:min(ends)] if ends else rest
    cut = rest.find("/")
    host, path = (rest, "") if cut < 0 else (rest[:cut], rest[cut:])
    return host.translate(_LOWER), path


_LOWER = {c: c + 32 for c in range(65, 91)}


def digest(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"))


@dataclass
class DigestArray:
    """Sorted digests, and for each its entry string and action, as one blob with offsets."""

    keys: bytes
    entries: list[str]
    actions: list[str]
    lengths: list[int]  # of path prefixes

    @classmethod
    def of(cls, entries: list[tuple[str, str]]) -> DigestArray:
        rows = sorted((digest(e), e, a) for e, a in dict(entries).items())
        lengths = sorted({len(e) - e.find("/") for _, e, _ in rows})
        return cls(np.array([r[0] for r in rows], np.uint64).tobytes(), [r[1] for r in rows], [r[2] for r in rows], lengths)

    def mapped(self) -> np.ndarray:
        """The digests, memory-mapped from a file in this worker's temporary folder."""
        name = xxhash.xxh64_hexdigest(self.keys)
        if name not in _maps:
            f = tempfile.NamedTemporaryFile(suffix=".digests")  # goes with the worker
            f.write(self.keys or bytes(8))
            f.flush()
            _maps[name] = np.memmap(f.name, np.uint64, "r", shape=(max(1, len(self.keys) // 8),))
        return _maps[name]

    def probe(self, hosts: list[str], paths: list[str]) -> list[int]:
        """Number of the longest fitting entry of each url, or -1."""
        keys, out = self.mapped(), [-1] * len(hosts)
        tries, owner = [], []
        for i, (h, p) in enumerate(zip(hosts, paths, strict=True)):
            labels = h.split(".") if h else []
            tails = [".".join(labels[j:]) for j in range(len(labels))]
            heads = [p[:n] for n in self.lengths if n <= len(p)]
            for t in tails:
                for x in heads:
                    tries.append(t + x)
                    owner.append(i)
        if not tries or not self.entries:
            return out
        d = np.array([digest(t) for t in tries], np.uint64)
        at = np.searchsorted(keys, d)
        for q in np.flatnonzero((at < len(keys)) & (keys[np.minimum(at, len(keys) - 1)] == d)):
            e = int(at[q])
            while e < len(keys) and keys[e] == d[q]:  # entries whose digests clash stand side by side
                if self.entries[e] == tries[q] and (out[owner[q]] < 0
                                                    or len(self.entries[e]) > len(self.entries[out[owner[q]]])):
                    out[owner[q]] = e
                e += 1
        return out


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], blocked: list[str] = (), id_col: str = "page_id",
               url: str = "url") -> DataFrame:
    """One row per row of ``pages``: id_col, host, path, rule, verdict, listed.

    ``rules`` are (entry, block or allow); ``blocked`` are entries of a blocklist, which decide where no rule fits
    (``listed`` is the entry that fits, else null; not listed: allow). A null url or one without ``://`` has an empty
    host and path, no rule, and is allowed. Equal rows get equal results; extra columns are ignored; an empty table
    gives an empty result. Lists longer than ``BLOCK_BYTES`` are probed in blocks.
    """
    sc = pages.sparkSession.sparkContext
    rule_list = sc.broadcast(DigestArray.of(list(rules)))
    blocks, size, part = [], 0, []
    for e in blocked:
        part.append((e, "block"))
        size += len(e)
        if size > BLOCK_BYTES:
            blocks, size, part = [*blocks, sc.broadcast(DigestArray.of(part))], 0, []
    if part:
        blocks.append(sc.broadcast(DigestArray.of(part)))

    def task(batches):
        for b in batches:
            split = [split_url(u) for u in b.column(url).to_pylist()]
            hosts, paths = [x[0] for x in split], [x[1] for x in split]
            found = [rule_list.value.probe(hosts, paths)]
            rule = [rule_list.value.entries[e] if e >= 0 else None for e in found[0]]
            verdict = [rule_list.value.actions[e] if e >= 0 else None for e in found[0]]
            listed: list[str | None] = [None] * len(hosts)
            for block in blocks:
                for i, e in enumerate(block.value.probe(hosts, paths)):
                    if e >= 0 and len(block.value.entries[e]) > len(listed[i] or ""):
                        listed[i] = block.value.entries[e]
            verdict = [v or ("block" if x else "allow") for v, x in zip(verdict, listed, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(id_col), *(pa.array(x, pa.string()) for x in (hosts, paths, rule, verdict, listed))],
                [id_col, "host", "path", "rule", "verdict", "listed"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(F.col(id_col), F.col(url)).mapInArrow(
        task, f"`{id_col}` {kind}, host string, path string, rule string, verdict string, listed string")
