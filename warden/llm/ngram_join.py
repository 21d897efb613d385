"""N-gram Jaccard join by tries, and the components of its links.

Documents whose 4-word shingle sets are equal are one node (the set's 64-bit
signature, checked by a second one). Shingles have one global order: by how
crowded their bucket of a fixed-size count sketch is, then by hash, so common
passages come last. Two nodes can only link if the first n - ceil(0.85 n) + 1
shingles of each, the prefixes, share one.

1. Prefix rows (shingle, node) are counted by shingle; those of shingles that
   one node only has go. What is left is small.
2. Shingles with up to ``CROWDED`` nodes give pairs of these, counted by pair: a
   link needs more than one shared prefix shingle, about half a prefix, and
   pairs with fewer go. The others are verified.
3. Shingles with more nodes (a passage that whole crowds consist of) are
   searched from hubs first: the least and the greatest node of each are
   verified against all its nodes, which is linear in these and joins a crowd of
   copies into one component.
4. What the hubs left apart is searched exactly: crowded shingles tie their
   nodes into regions, regions whose nodes are one component by now are done,
   and of the others the nodes outside the largest component are joined with
   all the region's nodes of sizes that can link, in blocks by size class and
   hash. Sets go in, links come out, no pair is a row.

A join of two sides puts one side's ordered sets into a path-compressed trie.
The traversal counts a shared path's overlap with all sets of the other side
once, and leaves a subtree as soon as the overlap so far and the remaining
lengths cannot reach the threshold any more. A block holds at most ``BLOCK``
sets and about ``BLOCK_BYTES`` (one set at least), and so does a salted group of
a hub's partners.

Links inside one component beyond those that built it are not looked at: the
components are what all links would give, and that is the result.

Defined cases: null and empty texts have no shingles and link with nothing (not
even with each other); a text of fewer than four words is one shingle; an empty
table gives no rows; very long texts are read whole, one set being as long as
its text; repeated rows are nodes like any copies, and each gets its row; rows
with null ids take part, and their component is named by the least id that is
there (null if none is); an id on rows with different texts has a row for each;
the least id names a component, so there are no ties; extra columns are left
out, or carried by ``one_each`` whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import batch, delete, pick, scratch, stored

WORDS = 4
PERCENT = 85
BUCKETS = 1 << 21  # of the count sketch: its size is the same for any corpus
CHUNK = 1 << 13
FILTER_BITS = 1 << 25  # of the filter of candidate documents
CLASS = -1.001 * float(np.log(PERCENT / 100))  # in logarithms of sizes: sets that link are in one size class or in neighbours
BLOCK = 256  # sets in one trie
BLOCK_BYTES = 16 << 20  # of the sets in one trie
CROWDED = 32  # nodes beyond which a shingle's nodes are joined in blocks instead of in pairs
_LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
_MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93))
_A, _B, _S = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), (np.uint64(30), np.uint64(27), np.uint64(31))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ x >> _S[0]) * _A
    x = (x ^ x >> _S[1]) * _B
    return x ^ x >> _S[2]


def need(n: np.ndarray | int) -> np.ndarray | int:
    """Least overlap of a set of size n with any set that it links to."""
    return (PERCENT * n + 99) // 100


def shingle_sets(texts: list[str | None], seed: int = 0) -> list[np.ndarray]:
    """Each text's set of shingle hashes, in numerical order."""
    number: dict[bytes, int] = {}
    nums: list[int] = []
    sizes = []
    for t in texts:
        words = t.encode().translate(_LOWER).split() if t else []  # bytes.split: blanks and \x09-\x0D
        sizes.append(len(words))
        nums += [number.setdefault(w, len(number)) for w in words]
    base = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in number), np.uint64, len(number))
    h = base[np.array(nums, np.int64)] if nums else np.zeros(0, np.uint64)
    out, at = [], 0
    if len(h) >= WORDS:
        grams = mixed(sum((h[k : len(h) - WORDS + 1 + k] * _MIX[k] for k in range(1, WORDS)), h[: len(h) - WORDS + 1] * _MIX[0]))
    for n in sizes:
        if n >= WORDS:
            out.append(np.unique(grams[at : at + n - WORDS + 1]))
        elif n:
            out.append(mixed(sum((h[at + k : at + k + 1] * _MIX[k] for k in range(n)), np.array([n], np.uint64))))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def signatures(s: np.ndarray) -> tuple[int, int]:
    """Two signed 64-bit signatures of a set."""
    a, b = np.add.reduce(mixed(s ^ _MIX[2])), np.add.reduce(mixed(s * _MIX[3] + _MIX[1]))
    return int(np.int64(a.view(np.int64))), int(np.int64(b.view(np.int64)))


def ordered(s: np.ndarray, crowd: np.ndarray) -> np.ndarray:
    """In the global order: by the bucket's count, then by hash."""
    return s[np.argsort(crowd[(s % np.uint64(len(crowd))).astype(np.int64)], kind="stable")]


_MAX_TEXTS = 512


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(0, b.num_rows, _MAX_TEXTS):
            yield b.slice(k, _MAX_TEXTS)


def nodes(docs: DataFrame, seed: int) -> DataFrame:
    """One pass over the texts: a row (id, node, check, n) for each document, and rows (chunk, counts) of the count sketch.

    node is null where there are no shingles. A task counts the shingles of its
    documents in one array of fixed size, whatever the corpus.
    """
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, schema = np.zeros(BUCKETS, np.uint32), None
        for b in _slices(batches):
            sets = shingle_sets(b.column(1).to_pylist(), seed)
            signed = [signatures(s) if len(s) else (None, None) for s in sets]
            schema = pa.schema([b.schema.field(0), ("node", pa.int64()), ("check", pa.int64()), ("n", pa.int64()), ("chunk", pa.int32()), ("counts", pa.binary())])
            yield batch(schema, b.column(0), [x[0] for x in signed], [x[1] for x in signed], [len(s) for s in sets], pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary()))
            if some := [s for s in sets if len(s)]:
                total += np.bincount((np.concatenate(some) % np.uint64(BUCKETS)).astype(np.int64), minlength=BUCKETS).astype(np.uint32)
        few = np.minimum(total, 255).astype(np.uint8).reshape(-1, CHUNK)  # what fills a bucket in one task is crowded as it is
        at = np.flatnonzero(few.any(axis=1))
        for k in range(0, len(at), 32):
            own = at[k : k + 32]
            yield batch(schema, pa.nulls(len(own), schema.field(0).type), *(pa.nulls(len(own), pa.int64()) for _ in range(3)), own.tolist(), [few[i].tobytes() for i in own])

    return docs.mapInArrow(run, f"id {kind}, node long, check long, n long, chunk int, counts binary")


def crowd_sketch(found: DataFrame) -> np.ndarray:
    """How many documents' shingles fall into each of ``BUCKETS`` buckets, as 16 bits in proportion: chunks are added up as they stream in."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held.setdefault(i, np.zeros(CHUNK, np.uint64))
                held[i] += np.frombuffer(raw, np.uint8)
        for i, x in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([x.astype("<u8").tobytes()], pa.binary())], names=["chunk", "counts"])

    parts = found.where("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(add, "chunk int, counts binary")
    out = np.zeros(BUCKETS, np.uint64)
    for r in parts.collect():  # BUCKETS numbers, whatever the corpus
        out[r[0] * CHUNK : (r[0] + 1) * CHUNK] = np.frombuffer(r[1], "<u8")
    top = int(out.max())
    return (out // np.uint64(max(1, -(-top // 65535)))).astype(np.uint16)


def prefixes(docs: DataFrame, crowd, seed: int) -> DataFrame:
    """(shingle, node, n): the prefix of each document's ordered set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            tokens, owner, sizes, seen = [], [], [], set()
            for s in shingle_sets(b.column(0).to_pylist(), seed):
                if not len(s) or (node := signatures(s)[0]) in seen:
                    continue
                seen.add(node)
                own = ordered(s, crowd.value)[: len(s) - need(len(s)) + 1]
                tokens.append(own)
                owner.append(np.full(len(own), node))
                sizes.append(np.full(len(own), len(s)))
            if tokens:
                cols = [np.concatenate(tokens).view(np.int64), np.concatenate(owner), np.concatenate(sizes).astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["shingle", "node", "n"])

    return docs.select("text").mapInArrow(run, "shingle long, node long, n int")


def _member_filter(hashes: DataFrame) -> np.ndarray:
    """Bits at the hashes (column h): a filter of fixed size (it lets others through, never the reverse)."""
    words = FILTER_BITS // 64
    bits = hashes.select(F.pmod("h", F.lit(FILTER_BITS)).alias("h")).select(F.floor(F.col("h") / 64).cast("int").alias("at"), F.expr("shiftleft(1L, cast(h % 64 as int))").alias("bit"))
    packed = bits.groupBy("at").agg(F.bit_or("bit").alias("bit"))
    out = np.zeros(words, np.int64)
    for b in packed.mapInArrow(_as_bytes, "at binary, bit binary").collect():  # at most FILTER_BITS / 64 numbers
        out[np.frombuffer(b[0], np.int32)] = np.frombuffer(b[1], np.int64)
    return out


def _as_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield pa.RecordBatch.from_arrays([pa.array([b.column(0).to_numpy().tobytes()], pa.binary()), pa.array([b.column(1).to_numpy().tobytes()], pa.binary())], names=["at", "bit"])


def _in_filter(bits: np.ndarray, h: np.ndarray) -> pa.Array:
    return pa.array((bits.view(np.uint64)[h // 64] >> (h % 64).astype(np.uint64) & np.uint64(1)) > 0)


def _holds(bits: np.ndarray, spark: SparkSession) -> Callable[[Column], Column]:
    """A function from a column of numbers below ``FILTER_BITS`` to whether the filter has them."""
    sent = spark.sparkContext.broadcast(bits)  # FILTER_BITS

    @F.arrow_udf("boolean")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield _in_filter(sent.value, b.to_numpy(zero_copy_only=False))

    return run


def shared_prefixes(rows: DataFrame, several: DataFrame) -> DataFrame:
    """The prefix rows of shingles that several nodes have: a fixed-size filter first, so that few are shuffled, then the join."""
    bits = rows.sparkSession.sparkContext.broadcast(_member_filter(several.select(F.col("shingle").alias("h"))))  # FILTER_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(_in_filter(bits.value, np.mod(b.column(0).to_numpy(), FILTER_BITS)))

    return rows.mapInArrow(run, "shingle long, node long, n int").join(several, "shingle").distinct()


def ordered_sets(docs: DataFrame, wanted: DataFrame, crowd, seed: int) -> DataFrame:
    """(node, path) of the wanted nodes (node, id: of a row that has it): the set from its most crowded shingle on, big-endian."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(_member_filter(wanted.select(F.xxhash64("id").alias("h"))))  # FILTER_BITS
    hashed = docs.select("text", F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS)).alias("h"))
    schema = pa.schema([("node", pa.int64()), ("path", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # an id can stand on several rows
        for b in _slices(batches):
            b = b.filter(_in_filter(bits.value, b.column(1).to_numpy(zero_copy_only=False)))
            rows = []
            for s in shingle_sets(b.column(0).to_pylist(), seed):
                if len(s) and (node := signatures(s)[0]) not in seen:
                    seen.add(node)
                    rows.append((node, ordered(s, crowd.value)[::-1].astype(">u8").tobytes()))
            yield batch(schema, [r[0] for r in rows], [r[1] for r in rows])

    found = hashed.mapInArrow(run, "node long, path binary").join(wanted.select("node").distinct(), "node", "left_semi")
    return found.groupBy("node").agg(F.first("path").alias("path"))  # by the join's own partitioning


# --- the trie


def trie_links(left: list[np.ndarray], paths: list[bytes]) -> Iterator[tuple[int, int]]:
    """(number of a left set, number of a path) of all that link; paths in byte order.

    The sorted paths are a path-compressed trie: a range of them whose common
    beginning is one edge. A range stands with its depth and, for all left sets
    at once, the overlap with what is above it, counted once however many paths
    share it. Left sets that the remaining lengths leave short of the threshold
    are dropped on the way down, and a subtree without any is not entered.
    """
    n = np.array([len(s) for s in left])
    every = np.concatenate(left)
    owner = np.repeat(np.arange(len(left)), n)
    order = np.argsort(every, kind="stable")
    tokens, starts = np.unique(every[order], return_index=True)
    owner, ends = owner[order], np.append(starts[1:], len(every))
    sets = [np.frombuffer(p, ">u8").astype(np.uint64) for p in paths]
    sizes = np.array([len(s) for s in sets])

    def counted(edge: np.ndarray) -> np.ndarray:
        """How many of the edge's shingles each left set has."""
        at = np.minimum(np.searchsorted(tokens, edge), len(tokens) - 1)
        at = at[tokens[at] == edge]
        many = ends[at] - starts[at]
        total = int(many.sum())
        if not total:
            return np.zeros(len(left), np.int64)
        places = np.arange(total) + np.repeat(starts[at] - np.concatenate([[0], np.cumsum(many)[:-1]]), many)
        return np.bincount(owner[places], minlength=len(left))

    todo = [(0, len(sets), 0, np.zeros(len(left), np.int64))]
    while todo:
        lo, hi, depth, overlap = todo.pop()
        few, most = sizes[lo:hi].min(), sizes[lo:hi].max()
        reach = overlap + np.minimum(most - depth, n - overlap)
        if not (reach * (100 + PERCENT) >= PERCENT * (n + few)).any():
            continue
        first, last = sets[lo], sets[hi - 1]
        m = min(len(first), len(last))
        differ = np.flatnonzero(first[depth:m] != last[depth:m]) if hi - lo > 1 else ()
        end = depth + int(differ[0]) if len(differ) else m
        if end > depth:
            overlap = overlap + counted(first[depth:end])
        while lo < hi and len(sets[lo]) == end:  # paths that end here come first
            for i in np.flatnonzero(overlap * (100 + PERCENT) >= PERCENT * (n + end)).tolist():
                yield i, lo
            lo += 1
        if lo < hi:
            heads = np.array([s[end] for s in sets[lo:hi]])
            cuts = [0, *(np.flatnonzero(heads[1:] != heads[:-1]) + 1).tolist(), hi - lo]
            todo += [(lo + a, lo + b, end, overlap) for a, b in zip(cuts, cuts[1:], strict=False)]


_LINKS = pa.schema([("hub", pa.int64()), ("node", pa.int64())])


def _joined(left: pa.Table, right: pa.Table) -> pa.Table:
    """Links between two blocks (node, label, path): of those, a forest over the labels."""
    if not left.num_rows or not right.num_rows:
        return _LINKS.empty_table()
    rows = sorted(zip(*(right[c].to_pylist() for c in ("right_path", "right_node", "right_label")), strict=True))
    own = list(zip(*(left[c].to_pylist() for c in ("node", "label")), strict=True))
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.get(x, x)) != x:
            up[x] = up.get(y, y)
            x = y
        return x

    found = []
    for i, j in trie_links([np.frombuffer(p, ">u8").astype(np.uint64) for p in left["path"].to_pylist()], [r[0] for r in rows]):
        a, b = top(own[i][1]), top(rows[j][2])
        if a != b:
            up[a] = b
            found.append((own[i][0], rows[j][1]))
    return pa.table([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], schema=_LINKS)


def _parts(count: Column, shingles: Column) -> Column:
    """Blocks that so many sets with so many shingles are dealt over."""
    return F.ceil(F.greatest(count / BLOCK, shingles * 8 / BLOCK_BYTES)).cast("int")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Of the candidate pairs (hub, node, n: the node's size): links, as many as the components need."""
    parts = pairs.groupBy("hub").agg(_parts(F.count("node"), F.sum("n")).alias("parts"))
    dealt = pairs.join(parts, "hub").withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    partners = dealt.join(sets, "node").select("hub", "part", F.col("node").alias("right_node"), F.col("node").alias("right_label"), F.col("path").alias("right_path"))
    hubs = parts.select(F.col("hub").alias("node"), "parts").join(sets, "node")
    hubs = hubs.select("node", F.col("node").alias("label"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("own_part"), "path")
    return hubs.groupBy("node", "own_part").cogroup(partners.groupBy("hub", "part")).applyInArrow(_joined, "hub long, node long")


def unsettled(members: DataFrame) -> DataFrame:
    """Of the members (region, class, node, n, label): those of regions with several labels, and whether theirs is the region's largest."""
    labels = members.groupBy("region", "label").agg(F.count("node").alias("n_nodes"))
    largest = labels.groupBy("region").agg(F.max(F.struct("n_nodes", "label")).alias("top"), F.count("label").alias("n_labels"))
    open_ = largest.where("n_labels > 1").select("region", F.col("top.label").alias("top"))
    return members.join(open_, "region").withColumn("large", F.col("label") == F.col("top")).drop("top")


def region_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links inside regions (region, class, node, n, label, large).

    Blocks meet those of their own and the next size class, but not two of the
    largest component. A class has its other nodes' blocks first (``others`` of
    ``parts``), then the largest component's.
    """
    large = F.col("large")
    some = lambda of, x: F.sum(F.when(of, x).otherwise(F.lit(0)))
    blocks = rows.groupBy("region", "class").agg(
        _parts(some(~large, F.lit(1)), some(~large, F.col("n"))).alias("others"), _parts(some(large, F.lit(1)), some(large, F.col("n"))).alias("rest")
    ).select("region", "class", "others", (F.col("others") + F.col("rest")).alias("parts"))
    beside = lambda step, name: blocks.select("region", (F.col("class") + step).alias("class"), F.col("parts").alias(f"{name}_parts"), F.col("others").alias(f"{name}_others"))
    dealt = rows.join(blocks, ["region", "class"]).join(beside(-1, "next"), ["region", "class"], "left").join(beside(1, "last"), ["region", "class"], "left")
    hashed = F.xxhash64("node")
    own = F.when(large, F.col("others") + F.pmod(hashed, F.col("parts") - F.col("others"))).otherwise(F.pmod(hashed, F.col("others"))).cast("int")
    dealt = dealt.withColumn("part", own).join(sets, "node")
    upto = lambda a, b: F.when(b >= a, F.sequence(a, b)).otherwise(F.array().cast("array<int>"))
    key = lambda c, i, d, j: F.struct(c.cast("int").alias("c"), i.alias("i"), d.cast("int").alias("d"), j.alias("j"))
    c, i, zero = F.col("class"), F.col("part"), F.lit(0)
    meets = lambda name: F.coalesce(F.when(large, F.col(f"{name}_others")).otherwise(F.col(f"{name}_parts")), zero) - 1
    lefts = F.concat(
        F.when(~large, F.transform(upto(i, F.col("parts") - 1), lambda j: key(c, i, c, j))).otherwise(F.array()),
        F.transform(upto(zero, meets("next")), lambda j: key(c, i, c + 1, j)),
    )
    rights = F.concat(
        F.transform(upto(zero, F.least(i, F.col("others") - 1)), lambda j: key(c, j, c, i)),
        F.transform(upto(zero, meets("last")), lambda j: key(c - 1, j, c, i)),
    )
    left = dealt.select("region", F.explode(lefts).alias("pair"), "node", "label", "path")
    right = dealt.select(F.col("region").alias("right_region"), F.explode(rights).alias("right_pair"), F.col("node").alias("right_node"), F.col("label").alias("right_label"), F.col("path").alias("right_path"))
    return left.groupBy("region", "pair").cogroup(right.groupBy("right_region", "right_pair")).applyInArrow(_joined, "hub long, node long")


# --- components


def components(edges: DataFrame, a: str = "hub", b: str = "node") -> DataFrame:
    """(node, label) of every node with an edge; the label is its component's least node.

    Alternating large and small stars; every round is written to the shared
    folder. Hot centres are aggregated before the shuffle, and the joins back
    to them are equi-joins that adaptive execution splits.
    """
    spark = edges.sparkSession
    now = stored(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large, before = stored(large, "edges"), now
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        now = stored(small, "edges")
        for df in (before, large):  # read for the last time
            delete(spark, df.stored_at)
        new = tuple(now.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if new == mark:
            break
        mark = new
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("label")).distinct())


def candidate_pairs(few: DataFrame, crowded: DataFrame) -> DataFrame:
    """(hub, node, n: the node's size): pairs of nodes whose shared prefix shingles can be enough.

    With w the lesser of the prefixes' last shingles, what the sets share up to
    w is in both prefixes, and past it at most the rest of one set. So a link
    needs that many shared prefix shingles; those among the crowded ones are
    taken as the most there can be.
    """
    more = crowded.groupBy("node").agg(F.count("shingle").alias("k"))
    left, right = few.select("shingle", F.col("node").alias("hub"), F.col("n").alias("hub_n")), few.select("shingle", "node", "n")
    met = left.join(right, "shingle").where(f"hub < node and 100 * least(n, hub_n) >= {PERCENT} * greatest(n, hub_n)")
    met = met.groupBy("hub", "node").agg(F.count("shingle").alias("c"), F.first("hub_n").alias("hub_n"), F.first("n").alias("n"))
    met = met.join(more.select(F.col("node").alias("hub"), F.col("k").alias("hub_k")), "hub", "left").join(more, "node", "left")
    rest = f"((({PERCENT} * greatest(n, hub_n) + 99) div 100) - 1)"
    wanted = f"(({PERCENT} * (n + hub_n) + {99 + PERCENT}) div {100 + PERCENT})"
    return met.where(f"c + least(coalesce(k, 0), coalesce(hub_k, 0)) >= {wanted} - {rest}").select("hub", "node", "n")


def links(docs: DataFrame, found: DataFrame, ids: DataFrame, seed: int) -> DataFrame:
    """(node, label) of the nodes that link with others; ids: (node, id: its representative)."""
    crowd = docs.sparkSession.sparkContext.broadcast(crowd_sketch(found))  # BUCKETS numbers
    rows = stored(prefixes(docs, crowd, seed), "prefixes")
    several = rows.groupBy("shingle").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a < b").select("shingle")
    shared = stored(shared_prefixes(rows, stored(several, "several")), "shared")
    sizes = shared.groupBy("shingle").agg(F.count("node").alias("members"), F.min("node").alias("first"), F.max("node").alias("last"))
    few = shared.join(sizes.where(f"members <= {CROWDED}").select("shingle"), "shingle")
    crowded = stored(shared.join(sizes.where(f"members > {CROWDED}").select("shingle", "first", "last"), "shingle"), "crowded")
    pairs = stored(candidate_pairs(few, crowded), "pairs")
    wanted = pairs.select("node").unionByName(pairs.select(F.col("hub").alias("node"))).unionByName(crowded.select("node")).distinct().join(ids, "node").select("id", "node")
    sets = stored(ordered_sets(docs, stored(wanted, "wanted"), crowd, seed), "sets")
    edges = stored(verified(pairs, sets), "links")
    if crowded.limit(1).count():
        hubs = crowded.select(F.explode(F.array("first", "last")).alias("hub"), "node", "n").where("hub <> node").distinct()
        edges = edges.unionByName(stored(verified(stored(hubs, "hubs"), sets), "links"))
        tied = components(crowded.select(F.col("first").alias("hub"), "node").distinct()).withColumnRenamed("label", "region")
        members = crowded.select("node", "n", F.floor(F.log("n") / CLASS).cast("int").alias("class")).distinct().join(tied, "node")
        members = members.join(components(edges), "node", "left").withColumn("label", F.coalesce("label", "node"))
        edges = edges.unionByName(stored(region_links(stored(unsettled(stored(members, "members")), "unsettled"), sets), "links"))
    return stored(components(edges), "labels")


def _named(docs: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, int]:
    """(id, node, n) of each row; (node, label, component_id) of each node; the seed that told all sets apart."""
    found = stored(nodes(docs, seed), "nodes")
    of = found.where("chunk is null").select("id", "node", "check", "n")
    ids = of.where("node is not null").groupBy("node").agg(F.min("id").alias("id"), F.min("check").alias("a"), F.max("check").alias("b"))
    if ids.where("a <> b").limit(1).count():  # two sets of one signature: as good as never
        return _named(docs, seed + 1)
    ids = stored(ids.select("node", "id"), "ids")
    with scratch(docs.sparkSession) as keep:
        labels = keep(links(docs, found, ids, seed))
    named = ids.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    return of.drop("check"), named.join(least, "label").select("node", "label", "component_id"), seed


def ngram_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """(id, n_shingles, component_id): the least id that links reach."""
    of, named, _ = _named(pick(docs, id_col, text_col).toDF("id", "text"), seed)
    return of.join(named.drop("label"), "node", "left").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 0) -> DataFrame:
    """All columns of one row of each component: one with the least id; of components without ids any one.

    Rows without shingles are components of their own, but repeated ones (of one
    id, or without any) stay once. Only rows whose id is null or stands on
    several rows have to be told apart by their texts.
    """
    of, named, seed = _named(pick(docs, id_col, text_col).toDF("id", "text"), seed)
    # narrow and stored, so that their sizes are known where texts meet them
    of, named = stored(of, "rows"), stored(named, "named")
    several = of.groupBy("id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1 or id is null").select("id")
    several = stored(several, "several")
    first = of.join(named, "node", "left").where("id = coalesce(component_id, id)").select(F.col("id").alias("k")).join(several.select(F.col("id").alias("k")), "k", "left_anti").distinct()
    first = stored(first, "first")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.col(f"`{id_col}`").alias("i"))
    # most rows stay; a filter of the ids that may not tells them, so that only the others' texts meet a join
    others = of.select("id").join(first.select(F.col("k").alias("id")), "id", "left_anti")
    in_doubt = _holds(_member_filter(others.select(F.xxhash64("id").alias("h"))), docs.sparkSession)(F.pmod(F.xxhash64("i"), F.lit(FILTER_BITS)))
    marked = whole.withColumn("in_doubt", in_doubt)
    sure, rest = marked.where("not in_doubt").select("d"), marked.where("in_doubt").drop("in_doubt")
    once = sure.unionByName(rest.join(first, F.col("i") == F.col("k"), "left_semi").select("d"))
    again = rest.join(several.select(F.col("id").alias("k")), F.col("i").eqNullSafe(F.col("k")), "left_semi")
    again = _with_node(again, text_col, seed).join(named.withColumnRenamed("node", "m"), F.col("node") == F.col("m"), "left")
    again = again.where("i is null or i = coalesce(component_id, i)").where("component_id is null or i is not null")
    kept = again.groupBy("label", F.when(F.col("label").isNull(), F.struct("i")).alias("bare")).agg(F.first("d").alias("d")).select("d")
    return once.unionByName(kept).select(*[F.col(f"d.`{c}`") for c in docs.columns])


def _with_node(rows: DataFrame, text_col: str, seed: int) -> DataFrame:
    """Rows (d, i) with the node of d's text (null without shingles)."""
    at = rows.schema["d"].dataType.names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = shingle_sets(b.column(0).field(at).to_pylist(), seed)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([signatures(s)[0] if len(s) else None for s in sets], pa.int64())], names=["d", "i", "node"])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("node", LongType())]))
