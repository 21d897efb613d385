"""Benchmark decontamination by suffix arrays over shards of the training words.

A shard is a run of documents of one input partition, at most ``shard_words``
words (one document at least). Its words become numbers of the benchmark's
vocabulary (0: no such word) and every position that holds a benchmark word is
a suffix. The suffixes are sorted by prefix doubling, to the depth of 16 words
that a window of 10 needs. All suffixes of the benchmark items that begin a
window are then binary-searched in the array: a range of equal beginnings gives
all the places of a window. Equal windows of several items are one, with the
list of its items beside it, so a place belongs to one window of each length.
Places are extended word by word for the longest verbatim match: of places and
items only those that agree so far go on. Nothing is shuffled: documents stay
where they were read.

The benchmark reaches the tasks in blocks of at most ``block_bytes`` of text, so
what a task holds has a fixed bound. With one block the documents are read once.
With more, a first pass keeps the distinct texts that meet a Bloom filter of all
windows (``FILTER_BITS`` at most; it lets other texts through, never the
reverse); only these are searched for block after block, and what is found goes
back to the documents by the text's 128-bit hash. The corpus is never rewritten.
Blocks, shards and the filter change the work, not the result.

Defined cases: null and empty texts have no words; an empty benchmark hits
nothing; empty documents give no rows; items shorter than the window are one
window each, items without words none; a longest match is one that holds a whole
window (0 and null without), the first one of equal length; repeated items count
by their ids; repeated documents each get their row; items with a null id hit
like others, and only the id is left out of the list of items; very long texts
are read whole, a document beyond a shard's size being a shard of its own; a
column of the documents that bears one of the result's names is left out of
``decontaminate`` and kept by ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from .common import alnum_words, batch, scratch, small_batches, stored

WINDOW = 10
SHARD_WORDS = 1 << 20
BLOCK_BYTES = 8 << 20
FILTER_BITS = 1 << 30
PROBES = 6  # bits of a window in the filter
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Queries:
    """A block's words, numbered, and its distinct windows with their places and items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.vocab: dict[bytes, int] = {}
        self.ids: list[str] = []
        number: dict[str, int] = {}
        words: list[int] = []
        starts, sizes, owner = [], [], []
        for item_id, text in items:
            own = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in alnum_words(text)]
            if not own:
                continue
            n = max(1, len(own) - window + 1)
            starts += range(len(words), len(words) + n)
            sizes += [min(window, len(own))] * n
            owner += [-1 if item_id is None else number.setdefault(item_id, len(number))] * n
            words += own
            words.append(0)  # no match runs over an item's end
        self.ids = list(number)
        self.depth = window
        self.words = np.array(words + [0] * window, np.int32)
        place, size, item = np.array(starts, np.int64), np.array(sizes, np.int64), np.array(owner, np.int64)
        rows = np.where(np.arange(window) < size[:, None], self.words[place[:, None] + np.arange(window)], 0) if len(place) else np.zeros((0, window), np.int32)
        #: One row for each distinct window; ``places`` and ``items`` of window k lie between its bounds.
        self.rows, of = np.unique(rows, axis=0, return_inverse=True) if len(place) else (rows, np.zeros(0, np.int64))
        of = of.reshape(-1)
        self.sizes = np.count_nonzero(self.rows, axis=1)
        order = np.argsort(of, kind="stable")
        self.places, self.place_at = place[order], np.searchsorted(of[order], np.arange(len(self.rows) + 1))
        pairs = np.unique(np.stack([of[item >= 0], item[item >= 0]], axis=1), axis=0) if len(place) else np.zeros((0, 2), np.int64)
        self.items, self.item_at = pairs[:, 1], np.searchsorted(pairs[:, 0], np.arange(len(self.rows) + 1))


def suffix_array(words: np.ndarray, depth: int) -> np.ndarray:
    """Positions of nonzero words, sorted by the ``depth`` words that follow (zeros past the end)."""
    rank, at = words.astype(np.int32), np.flatnonzero(words).astype(np.int32)
    n, span = len(rank), 1
    while span < depth:
        key = rank[at].astype(np.int64) * (int(rank.max(initial=0)) + 1)
        inside = at < n - span
        key[inside] += rank[at[inside] + span]
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank[at[order]] = np.cumsum(np.diff(key, prepend=key[:1] - 1) != 0, dtype=np.int32)
        span *= 2
    return at[np.argsort(rank[at], kind="stable")]


def _compare(words: np.ndarray, at: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sign of suffix against query row, over the row's own words only."""
    sign, open_ = np.zeros(len(at), np.int8), np.ones(len(at), bool)
    for k in range(rows.shape[1]):
        open_ &= k < sizes
        if not open_.any():
            break
        here = np.where(at + k < len(words), words[np.minimum(at + k, len(words) - 1)], -1)
        d = np.sign(here - rows[:, k]).astype(np.int8)
        sign = np.where(open_ & (d != 0), d, sign)
        open_ &= d == 0
    return sign


def search(words: np.ndarray, sa: np.ndarray, q: Queries) -> tuple[np.ndarray, np.ndarray]:
    """Of each window: the range of the suffix array that begins with it."""
    bounds = []
    for upper in (0, 1):
        lo, hi = np.zeros(len(q.rows), np.int64), np.full(len(q.rows), len(sa), np.int64)
        while (busy := np.flatnonzero(lo < hi)).size:
            mid = (lo[busy] + hi[busy]) // 2
            right = _compare(words, sa[mid], q.rows[busy], q.sizes[busy]) < upper
            lo[busy] = np.where(right, mid + 1, lo[busy])
            hi[busy] = np.where(right, hi[busy], mid)
        bounds.append(lo)
    return bounds[0], bounds[1]


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number of every range lo..hi, and the range that it is of."""
    count = hi - lo
    of = np.repeat(np.arange(len(count)), count)
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count), of


def extended(words: np.ndarray, at: np.ndarray, of: np.ndarray, q: Queries) -> np.ndarray:
    """Words that agree with some item from each place on.

    Places and the items' places carry the number of the word sequence they
    have in common so far, so neither meets the other pair by pair.
    """
    out = q.sizes[of].copy()
    hit = np.unique(of)
    item_at, group = _spread(q.place_at[hit], q.place_at[hit + 1])
    item_at, group = q.places[item_at], hit[group]
    live, mine, base = np.arange(len(at)), of.copy(), len(q.vocab) + 1
    size, item_size = out.copy(), q.sizes[group].copy()
    while len(live):
        a, b = at[live] + size, item_at + item_size
        nxt = np.where(a < len(words), words[np.minimum(a, len(words) - 1)], 0).astype(np.int64)
        item_nxt = np.where(b < len(q.words), q.words[np.minimum(b, len(q.words) - 1)], 0).astype(np.int64)
        key, item_key = mine * base + nxt, group * base + item_nxt
        known = np.unique(item_key[item_nxt > 0])
        if not len(known):
            break
        where = np.minimum(np.searchsorted(known, key), len(known) - 1)
        ok = (nxt > 0) & (known[where] == key)
        live, mine, size = live[ok], where[ok], size[ok] + 1
        out[live] = size
        where = np.minimum(np.searchsorted(known, item_key), len(known) - 1)
        go = (item_nxt > 0) & (known[where] == item_key) & np.isin(where, mine)
        item_at, group, item_size = item_at[go], where[go], item_size[go] + 1
    return out


def merged(spans: list[tuple[int, int]]) -> list[int]:
    """Spans without overlaps, as one flat list start, end, start, end."""
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += (a, b)
    return out


def _numbers(text: str | None, q: Queries) -> np.ndarray:
    """A text's words as numbers of the block's vocabulary."""
    words = alnum_words(text)
    get = q.vocab.get
    return np.fromiter((get(w, 0) for w in words), np.int32, len(words))


def _shard(docs: list[np.ndarray], q: Queries) -> list[tuple[int, list[int], list[str], int, int | None]]:
    """Of each document: words, hit places as merged start, end, items, the longest match and its place."""
    sizes = [len(d) for d in docs]
    out: list[tuple[int, list[int], list[str], int, int | None]] = [(n, [], [], 0, None) for n in sizes]
    if not len(q.rows):
        return out
    ends = np.cumsum([n + 1 for n in sizes])
    words = np.zeros(int(ends[-1]) + 1, np.int32)
    for d, end in zip(docs, ends.tolist(), strict=True):
        words[end - 1 - len(d) : end - 1] = d
    sa = suffix_array(words, q.depth)
    at, of = _spread(*search(words, sa, q))
    if not len(at):
        return out
    at = sa[at]
    long = extended(words, at, of, q)
    doc = np.searchsorted(ends, at, "right")
    begin = ends - 1 - np.array(sizes)
    order = np.lexsort((at, doc))
    at, of, long, doc = at[order], of[order], long[order], doc[order]
    cuts = np.flatnonzero(np.diff(doc, prepend=-1)).tolist()
    for a, b in zip(cuts, [*cuts[1:], len(doc)], strict=True):
        d = int(doc[a])
        place = at[a:b] - begin[d]
        spans = merged(list(zip(place.tolist(), (place + q.sizes[of[a:b]]).tolist(), strict=True)))
        hit = np.unique(of[a:b])
        items = np.unique(q.items[_spread(q.item_at[hit], q.item_at[hit + 1])[0]])
        best = int(np.argmax(long[a:b]))
        out[d] = (sizes[d], spans, sorted(q.ids[i] for i in items.tolist()), int(long[a + best]), int(place[best]))
    return out


#: What the result adds to the documents' own columns.
STATE = (("_n_words", "long"), ("_n_hit", "long"), ("_hits", "array<long>"), ("_items", "array<string>"), ("_longest_match", "long"), ("_longest_start", "long"))
_KINDS = (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.int64(), pa.int64())


def _covered(spans: list[int]) -> int:
    return sum(spans[1::2]) - sum(spans[::2])


def _searched(batches: Iterator[pa.RecordBatch], at: int, q: Queries, shard_words: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Batches (slices of those that come in) with their documents' results, shard by shard."""
    held: list[pa.RecordBatch] = []
    words: list[np.ndarray] = []
    size = 0

    def done() -> Iterator[tuple[pa.RecordBatch, list]]:
        rows, k = _shard(words, q), 0
        for b in held:
            yield b, [(n, _covered(s), s, i, m, p) for n, s, i, m, p in rows[k : k + b.num_rows]]
            k += b.num_rows

    for b in batches:
        start, texts = 0, b.column(at)
        for i in range(b.num_rows):
            w = _numbers(texts[i].as_py(), q)
            if words and size + len(w) > shard_words:
                if i > start:
                    held.append(b.slice(start, i - start))
                yield from done()
                held, words, size, start = [], [], 0, i
            words.append(w)
            size += len(w) + 1
        if b.num_rows > start:
            held.append(b.slice(start))
    if words:
        yield from done()


def _benchmark(benchmark: DataFrame, limit: int) -> tuple[DataFrame, int, int]:
    """The distinct items (item_id, text), the number of their blocks and of their bytes."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")).distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return items, max(1, -(-size // limit)), size


def _blocks(items: DataFrame, n: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items in ``n`` blocks by hash; the driver holds one at a time."""
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect() if n > 1 else items.collect()
        yield sorted(((r[0], r[1]) for r in rows), key=lambda x: (x[0] is None, x[0] or "", x[1]))


# --- more than one block: the texts that may hit


def _windows(words: list[bytes], sizes: list[int], hashes: dict[bytes, int]) -> np.ndarray:
    """Hashes of all windows of the given sizes (each size has its own)."""
    h = np.fromiter((hashes.get(w) or hashes.setdefault(w, xxhash.xxh3_64_intdigest(w)) for w in words), np.uint64, len(words))
    out = [np.zeros(0, np.uint64)]
    for n in sizes:
        if len(h) >= n:
            x = np.full(len(h) - n + 1, n, np.uint64) * _ODD
            for k in range(n):
                x = (x ^ h[k : len(h) - n + 1 + k]) * _ODD
                x ^= x >> np.uint64(29)
            out.append(x)
    return np.concatenate(out)


def _probe(x: np.ndarray, k: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Byte and bit of each window hash's k-th place in a filter of ``size`` bits."""
    at = (x + np.uint64(k) * (x * _ODD | np.uint64(1))) >> np.uint64(8) & np.uint64(size - 1)
    return (at >> np.uint64(3)).astype(np.int64), (at & np.uint64(7)).astype(np.uint8)


def window_filter(items: DataFrame, n_blocks: int, n_bytes: int, window: int) -> tuple[np.ndarray, list[int]]:
    """A Bloom filter of all windows, added up block by block, and the windows' sizes."""
    size = 1 << max(10, min(FILTER_BITS.bit_length() - 1, (4 * n_bytes).bit_length()))  # a window has two bytes and more
    bits, sizes = np.zeros(size // 8, np.uint8), set()
    for block in _blocks(items, n_blocks):
        hashes: dict[bytes, int] = {}
        for _, text in block:
            words = alnum_words(text)
            if words:
                n = min(window, len(words))
                sizes.add(n)
                x = _windows(words, [n], hashes)
                for k in range(PROBES):
                    byte, bit = _probe(x, k, size)
                    np.bitwise_or.at(bits, byte, np.left_shift(np.uint8(1), bit))
    return bits, sorted(sizes)


def _may_hit(x: np.ndarray, bits: np.ndarray) -> bool:
    for k in range(PROBES):
        byte, bit = _probe(x, k, len(bits) * 8)
        x = x[bits[byte] >> bit & 1 > 0]
        if not len(x):
            return False
    return True


def _suspects(docs: DataFrame, text_col: str, bits: np.ndarray, sizes: list[int]) -> DataFrame:
    """(hash, text) of the distinct texts with a window in the filter."""
    sent = docs.sparkSession.sparkContext.broadcast((bits, sizes))  # FILTER_BITS at most

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sizes = sent.value
        seen: set[bytes] = set()
        for b in batches:
            rows, hashes = [], {}
            for t in b.column(0).to_pylist():
                if t and _may_hit(_windows(alnum_words(t), sizes, hashes), bits) and (key := xxhash.xxh3_128_digest(t)) not in seen:
                    seen.add(key)
                    rows.append((key, t))
            yield batch(pa.schema([("hash", pa.binary()), ("text", pa.string())]), [r[0] for r in rows], [r[1] for r in rows])

    found = docs.select(F.col(f"`{text_col}`").alias("text")).mapInArrow(run, "hash binary, text string")
    return found.groupBy("hash").agg(F.first("text").alias("text"))


_FOUND = "hash binary, hits array<long>, items array<string>, longest long, start long"


def _pass(suspects: DataFrame, block: list[tuple[str | None, str]], window: int, shard_words: int) -> DataFrame:
    """What one block hits in the texts, without the texts."""
    sent = suspects.sparkSession.sparkContext.broadcast(Queries(block, window))  # one block: bounded by block_bytes
    schema = pa.schema([("hash", pa.binary()), *zip(("hits", "items", "longest", "start"), _KINDS[2:], strict=True)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in _searched(batches, 1, sent.value, shard_words):
            hit = [(h, *r[2:]) for h, r in zip(b.column(0).to_pylist(), rows, strict=True) if r[1]]
            yield batch(schema, *([x[k] for x in hit] for k in range(5)))

    return suspects.mapInArrow(run, _FOUND)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of a text out of its blocks' rows."""
    schema = pa.schema([("hash", pa.binary()), *zip(("n_hit", "hits", "items", "longest", "start"), _KINDS[1:], strict=True)])
    for b in batches:
        out = []
        for h, rows in zip(*(c.to_pylist() for c in b.columns), strict=True):
            spans = merged([p for r in rows for p in zip(r["hits"][::2], r["hits"][1::2], strict=True)])
            best = max(rows, key=lambda r: (r["longest"], -r["start"]))
            out.append((h, _covered(spans), spans, sorted({i for r in rows for i in r["items"]}), best["longest"], best["start"]))
        yield batch(schema, *([x[k] for x in out] for k in range(6)))


def _found(docs: DataFrame, items: DataFrame, n_blocks: int, n_bytes: int, window: int, shard_words: int, text_col: str) -> DataFrame:
    """(hash, n_hit, hits, items, longest, start) of the texts that any block hits."""
    with scratch(docs.sparkSession) as keep:
        suspects = stored(_suspects(docs, text_col, *window_filter(items, n_blocks, n_bytes, window)), "suspects")
        parts = [stored(_pass(suspects, block, window, shard_words), "hits") for block in _blocks(items, n_blocks)]
        every = parts[0]
        for p in parts[1:]:
            every = every.unionByName(p)
        rows = every.groupBy("hash").agg(F.collect_list(F.struct("hits", "items", "longest", "start")).alias("rows"))  # a row for each block at most
        return keep(stored(rows.mapInArrow(_joined, "hash binary, n_hit long, hits array<long>, items array<string>, longest long, start long"), "found"))


def _hashed(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """(d: the columns to keep, n_words, hash of the text)."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep] or [F.lit(0).alias("none")]).alias("d"), F.col(f"`{text_col}`").alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            cols = [b.column(0), pa.array([len(alnum_words(t)) for t in texts], pa.int64()), pa.array([xxhash.xxh3_128_digest(t or "") for t in texts], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["d", "n_words", "hash"])

    return own.mapInArrow(run, StructType([own.schema[0], StructField("n_words", LongType()), StructField("hash", BinaryType())]))


# --- the operator


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES, text_col: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text (and those named as in ``STATE``), and ``STATE``."""
    small_batches(docs.sparkSession)
    keep = [c for c in docs.columns if c != text_col and c not in dict(STATE)]
    items, n_blocks, n_bytes = _benchmark(benchmark, block_bytes)
    if n_blocks > 1:
        found = _found(docs, items, n_blocks, n_bytes, window, shard_words, text_col)
        both = _hashed(docs, keep, text_col).join(found, "hash", "left")
        none = F.array().cast("array<long>"), F.array().cast("array<string>")
        state = [F.col("n_words"), F.coalesce("n_hit", F.lit(0)), F.coalesce("hits", none[0]), F.coalesce("items", none[1]), F.coalesce("longest", F.lit(0)), F.col("start")]
        return both.select(*[F.col(f"d.`{c}`") for c in keep], *[x.cast(kind).alias(name) for x, (name, kind) in zip(state, STATE, strict=True)])
    sent = docs.sparkSession.sparkContext.broadcast(Queries(next(_blocks(items, 1)), window))  # one block: bounded by block_bytes
    own = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in _searched(batches, len(keep), sent.value, shard_words):
            cols = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(_KINDS)]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], *cols], names=[*keep, *dict(STATE)])

    state = StructType([StructField(name, kind) for name, kind in zip(dict(STATE), (LongType(), LongType(), ArrayType(LongType()), ArrayType(StringType()), LongType(), LongType()), strict=True)])
    return own.mapInArrow(run, StructType([*own.schema.fields[: len(keep)], *state.fields]))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS, block_bytes: int = BLOCK_BYTES, text_col: str = "text") -> DataFrame:
    """The documents without a hit word, with their own columns."""
    small_batches(docs.sparkSession)
    items, n_blocks, n_bytes = _benchmark(benchmark, block_bytes)
    if n_blocks > 1:
        found = _found(docs, items, n_blocks, n_bytes, window, shard_words, text_col)
        left = _hashed(docs, docs.columns, text_col).join(found.select("hash"), "hash", "left_anti")
        return left.select(*[F.col(f"d.`{c}`") for c in docs.columns])
    sent = docs.sparkSession.sparkContext.broadcast(Queries(next(_blocks(items, 1)), window))  # one block: bounded by block_bytes
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, rows in _searched(batches, at, sent.value, shard_words):
            yield b.filter(pa.array([not r[1] for r in rows], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
