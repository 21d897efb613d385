"""URL filter: all glob rules at once in one bit-parallel (Shift-And) automaton.

Every rule is a glob over the canonical form ``.host#path``: ``*`` stands for
any run of bytes, ``?`` for one byte. The globs' positions are packed one after
the other into 64-bit words. A step over one byte of a URL is

    D = (((D << 1) & ~FIRST) | START) & MASK[byte]  |  (D & LOOP)

where LOOP has the positions that a ``*`` follows and START the first positions
of globs that begin with ``*`` (of all globs before the first byte). numpy runs
that step for a whole batch of URLs; a glob matches if its last position is set
at the end. ``#`` cannot occur in a host or path, so it marks their border.

Defined cases: a null URL, or one without ``://``, has an empty host and path
and fits no rule; repeated rows give repeated rows; ids may be null; an empty
table gives an empty result; further input columns are left out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, lower_ascii, map_batches, pick

#: (action, "host/path"): a host with all its subdomains and a prefix of the path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
#: (action, glob over ``.host#path``) for what no rule above fits; the longest that matches wins.
GLOBS = (
    ("block", "*.spam-farm.*#*"),
    ("block", "*.cheap-pills.*#*"),
    ("block", "*casino*#*"),
    ("block", "*.xxx#*"),
    ("block", "*.doubleclick.*#*"),
    ("block", "*.ads.*#*"),
    ("block", "*.ad?.*#*"),
    ("block", "*.tracker.*#*"),
    ("block", "*#*/ads/*"),
    ("block", "*#*/banner/*"),
    ("block", "*#*/wp-admin/*"),
    ("block", "*#*/cgi-bin/*"),
    ("block", "*#*.exe"),
    ("block", "*#*.zip"),
    ("block", "*#*/login"),
    ("block", "*#*/signup"),
    ("allow", "*.edu#*"),
    ("allow", "*.gov#*"),
    ("allow", "*#*/docs/*.html"),
)
_CELLS = 1 << 22  # bytes of URLs that are looked at together


def rule_glob(rule: str) -> str:
    host, _, path = rule.partition("/")
    return f"*.{host}#/{path}*"


class ShiftAnd:
    """Globs packed into multiword masks."""

    def __init__(self, globs: Sequence[str]):
        tokens = []  # (byte or None for any, first, from the start, loops, last)
        self.last = []
        self.always = []
        for glob in globs:
            raw = glob.encode()
            parts = [x for x in raw if x != 0x2A]
            self.always.append(not parts)
            loop, k = [False] * len(parts), -1
            for x in raw:
                if x == 0x2A:
                    if k >= 0:
                        loop[k] = True
                else:
                    k += 1
            for i, x in enumerate(parts):
                tokens.append((None if x == 0x3F else x, i == 0, raw[:1] == b"*", loop[i]))
            self.last.append(len(tokens) - 1)
        n = max(1, -(-len(tokens) // 64))
        self.mask = np.zeros((256, n), np.uint64)
        self.first, self.lead, self.loop = (np.zeros(n, np.uint64) for _ in range(3))
        for i, (x, first, lead, loop) in enumerate(tokens):
            w, bit = i // 64, np.uint64(1 << (i % 64))
            if x is None:
                self.mask[:, w] |= bit
            else:
                self.mask[x, w] |= bit
            self.first[w] |= bit if first else np.uint64(0)
            self.lead[w] |= bit if first and lead else np.uint64(0)
            self.loop[w] |= bit if loop else np.uint64(0)

    def match(self, texts: Sequence[bytes]) -> np.ndarray:
        """Boolean matrix: text by glob."""
        out = np.zeros((len(texts), len(self.last)), bool)
        order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
        at = 0
        while at < len(order):
            wide = max(1, len(texts[order[at]]))
            rows = order[at : at + max(1, _CELLS // wide)]
            out[rows] = self._match(texts, rows, wide)
            at += len(rows)
        return out

    def _match(self, texts: Sequence[bytes], rows: list[int], wide: int) -> np.ndarray:
        sizes = np.array([len(texts[i]) for i in rows])
        cells = np.zeros((len(rows), wide), np.uint8)
        for k, i in enumerate(rows):
            cells[k, : sizes[k]] = np.frombuffer(texts[i], np.uint8)
        one, top = np.uint64(1), np.uint64(63)
        d = np.zeros((len(rows), len(self.first)), np.uint64)
        live = np.searchsorted(-sizes, -np.arange(1, wide + 1), "right")  # rows that reach this byte
        for pos in range(wide):
            n = live[pos]
            if not n:
                break
            cur = d[:n]
            nxt = cur << one
            nxt[:, 1:] |= cur[:, :-1] >> top
            nxt = ((nxt & ~self.first) | (self.lead if pos else self.first)) & self.mask[cells[:n, pos]]
            d[:n] = nxt | (cur & self.loop)
        last = np.array(self.last)
        hit = (d[:, np.maximum(last, 0) // 64] >> (np.maximum(last, 0) % 64).astype(np.uint64)) & one
        return (hit > 0) | np.array(self.always)


@functools.lru_cache(maxsize=8)
def _compiled(rules: tuple, globs: tuple) -> ShiftAnd:
    return ShiftAnd([rule_glob(r) for _, r in rules] + [g for _, g in globs])


def _longest(hits: np.ndarray, names: Sequence[str]) -> np.ndarray:
    """Index of the longest hit by row (the first of equal ones), -1 for none."""
    order = sorted(range(len(names)), key=lambda i: -len(names[i].encode()))
    out = np.full(len(hits), -1)
    for i in reversed(order):
        out[hits[:, i]] = i
    return out


def url_filter(pages: DataFrame, rules: tuple = RULES, globs: tuple = GLOBS, default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict, method_rule): the longest rule that fits decides, else the longest glob, else ``default``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rest = F.when(F.locate("://", url) > 0, url.substr(F.locate("://", url) + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract("rest", "^[^/?#]*", 0)
    parts = (
        pick(pages, id_col, url_col).toDF("id", "url")
        .select("id", rest.alias("rest"))
        .select("id", lower_ascii(host).alias("host"), F.regexp_extract(F.expr("substring(rest, length(regexp_extract(rest, '^[^/?#]*', 0)) + 1)"), "^[^?#]*", 0).alias("path"))
    )
    id_type = parts.schema["id"].dataType.simpleString()

    def judge(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        hosts, paths = b.column(1).to_pylist(), b.column(2).to_pylist()
        m = _compiled(rules, globs).match([f".{h}#{p}".encode() for h, p in zip(hosts, paths, strict=True)])
        base, more = _longest(m[:, : len(rules)], [r for _, r in rules]), _longest(m[:, len(rules) :], [g for _, g in globs])
        schema = pa.schema([pa.field("id", b.schema.field(0).type), *(pa.field(c, pa.string()) for c in ("host", "path", "rule", "verdict", "method_rule"))])
        yield batch(
            schema, b.column(0), b.column(1), b.column(2), [rules[i][1] if i >= 0 else None for i in base],
            [rules[i][0] if i >= 0 else globs[j][0] if j >= 0 else default for i, j in zip(base, more, strict=True)],
            [globs[j][1] if j >= 0 else None for j in more],
        )

    return map_batches(parts, judge, f"id {id_type}, host string, path string, rule string, verdict string, method_rule string").withColumnRenamed("id", id_col)
