"""BPE encoding and decoding through a table of distinct words.

The tokenizer normalizes and splits without ever looking past white space, so a
text's ids are those of its words (split at ASCII white space) one after the
other. The words are encoded once each:

1. Documents are cut into blocks of bounded size. A block is stored as its
   distinct words, dealt over buckets by hash, and each document's words as
   numbers into them (packed, the most frequent words having the least numbers).
2. The blocks' words meet by bucket: a distinct word's row is encoded once,
   whichever blocks it comes from, and its ids go back to each of those blocks.
   The id-to-piece table (of the fixed size of the vocabulary) joins the ids
   for decoding.
3. Each block's words with their ids and pieces meet the block's numbers again:
   ids and decoded texts by position, document by document.

Words are shuffled once for each block they occur in. Texts are not shuffled:
their numbers lie in a table bucketed by block, where the ids come to them.
There are as many buckets as shuffle partitions, so a bucket stays small where
those are sized to the data; a word that is in every block is one entry of each,
and a block has no more rows than distinct words however many buckets there are.

``bpe_rows`` is the same in plain joins, with a row for each word and each
token: words are split by Spark, the distinct ones encoded, ids joined back by
word and position and pieces by id. It shuffles several times the text.

Defined cases: null and empty texts have no ids and decode to an empty text; an
empty table gives no rows; null ids are kept; repeated rows give repeated rows;
there are no ties, a word's ids being one sequence; very long texts are read
whole (a text over the block's size is a block of its own); extra columns,
whatever their names, are left out; the strings of special tokens in a text are
those tokens, as in the library; a vocabulary that looks across white space, or
decodes otherwise than by blanks, is refused.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, pick

TOKENIZER = "word_bpe_49k.json"
BLOCK_BYTES = 8 << 20
BUCKETS_LEAST = 24
#: Words that are Python objects, or expanded to tokens, at a time.
STEP = 1 << 15
_BLOCK_TYPES = "block string, bucket int, docs binary, counts binary, numbers binary, words binary"


def tokenizer_json(path: str | None = None) -> str:
    """A vocabulary file's content (read at the driver, sent to tasks); without a path the installed public word-BPE file."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    with open(path, encoding="utf-8") as f:
        return f.read()


@functools.lru_cache(maxsize=2)
def _tokenizer(text: str):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(text)
    t.no_truncation()
    t.no_padding()
    pieces = [t.id_to_token(i) or "" for i in range(t.get_vocab_size(with_added_tokens=True))]
    return t, pieces


@functools.lru_cache(maxsize=2)
def _pieces(text: str) -> pa.Array:
    return pa.array(_tokenizer(text)[1], pa.string())


_PROBES = ("a b", "ab\tcd\nef\rgh", " x  y ", "don't stop", "A\u0301 e\u0301 \u0301", "12 3.5, (x) [y]", "\u00df \u6f22\u5b57 \U0001f600", "a\x0bb\x0cc", "...\n\n...", "a\u00a0b c\u2003d", "")


def check_vocabulary(text: str) -> None:
    """Refuses a tokenizer whose ids of a text are not those of its words, or whose decoder is no join by blanks."""
    spec = json.loads(text)
    parts = lambda x, name: [] if x is None else x[name] if x["type"] == "Sequence" else [x]
    odd = [n["type"] for n in parts(spec["normalizer"], "normalizers") if n["type"] not in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase", "Replace")]
    odd += [a["content"] for a in spec["added_tokens"] if a["lstrip"] or a["rstrip"] or a["content"].split() != [a["content"]]]
    if spec["decoder"] is not None:
        odd.append(spec["decoder"]["type"])
    t, pieces = _tokenizer(text)
    ids = lambda x: t.encode(x, add_special_tokens=False).ids
    for x in _PROBES:
        by_word = [i for w in x.encode().split() for i in ids(w.decode())]
        if ids(x) != by_word or t.decode(by_word, skip_special_tokens=False) != " ".join(pieces[i] for i in by_word):
            odd.append(repr(x))
    if odd:
        raise ValueError(f"not a tokenizer of single words: {', '.join(odd)}")


def _zip(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x)


def _unzip(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def pack(x: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by byte plane, compressed."""
    planes = np.ascontiguousarray(x.astype("<u4")).view(np.uint8).reshape(-1, 4)
    return _zip(np.ascontiguousarray(planes.T).tobytes())


def unpack(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(_unzip(raw), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view("<u4")


class _Block:
    """Documents on their way into a block; their words are told apart when it is full, as Arrow columns: an object for each would take several times the text."""

    def __init__(self) -> None:
        self.texts: list[pa.Array] = []
        self.ids: list[pa.Array] = []
        self.docs = self.size = 0

    def add(self, ids: pa.Array, texts: pa.Array) -> None:
        self.ids.append(ids)
        self.texts.append(texts)

    def words(self) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """Numbers of words by document, the words by number, and the distinct words."""
        counts, words = [], []
        for x in self.texts:
            lists = pc.ascii_split_whitespace(x.fill_null(""))
            flat = lists.flatten()
            some = np.asarray(pc.binary_length(flat)) > 0  # a blank at either end leaves an empty word
            upto = np.concatenate([[0], np.cumsum(some)])
            counts.append(np.diff(upto[np.asarray(lists.offsets) - lists.offsets[0].as_py()]))
            words.append(flat.filter(pa.array(some)))
        coded = pa.chunked_array(words).dictionary_encode().chunks  # all have the same dictionary
        return np.concatenate(counts), np.concatenate([x.indices for x in coded]), coded[0].dictionary.cast(pa.binary())

    def rows(self, name: str, buckets: int) -> Iterator[dict]:
        counts, flat, words = self.words()
        self.texts = []
        pa.default_memory_pool().release_unused()
        times = np.bincount(flat, minlength=len(words))
        of = np.fromiter((xxhash.xxh3_64_intdigest(w) % buckets for k in range(0, len(words), STEP) for w in words[k : k + STEP].to_pylist()), np.int32, len(words))
        # frequent words first; then by bucket and text, so that a bucket's words are like neighbours and its numbers runs
        keys = pa.table({"times": times, "of": of, "word": words})
        ranked = np.asarray(pc.sort_indices(keys, [("times", "descending"), ("of", "ascending"), ("word", "ascending")])).astype(np.int64)
        rank = np.empty(len(words), np.uint32)
        rank[ranked] = np.arange(len(words), dtype=np.uint32)
        sink = pa.BufferOutputStream()
        column = pa.chunked_array(self.ids)
        with pa.ipc.new_stream(sink, pa.schema([("id", column.type)])) as out:
            out.write_table(pa.table([column], names=["id"]))
        yield {"block": name, "docs": _zip(sink.getvalue().to_pybytes()), "counts": pack(counts), "numbers": pack(rank[flat])}
        by_bucket = np.argsort(of[ranked], kind="stable")
        for own in np.split(by_bucket, np.flatnonzero(np.diff(of[ranked][by_bucket])) + 1) if len(words) else []:
            yield {"block": name, "bucket": int(of[ranked[own[0]]]), "numbers": pack(np.diff(own, prepend=0)), "words": _zip(b"\n".join(words.take(pa.array(ranked[own])).to_pylist()))}


def _frame(rows: list[dict]) -> pa.RecordBatch:
    schema = pa.schema([("block", pa.string()), ("bucket", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("numbers", pa.binary()), ("words", pa.binary())])
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in schema], schema=schema)


def split_blocks(docs: DataFrame, buckets: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each block of documents, and one for each of its buckets of distinct words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, no, block = TaskContext.get().partitionId(), 0, _Block()
        for b in batches:
            at, texts = 0, b.column(1)
            for i, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
                if block.docs and block.size + size > block_bytes:
                    block.add(b.column(0).slice(at, i - at), texts.slice(at, i - at))
                    for r in block.rows(f"{part}-{no}", buckets):
                        yield _frame([r])
                    block, at, no = _Block(), i, no + 1
                block.docs += 1
                block.size += size
            block.add(b.column(0).slice(at), texts.slice(at))
        if block.docs:
            for r in block.rows(f"{part}-{no}", buckets):
                yield _frame([r])
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return docs.mapInArrow(run, _BLOCK_TYPES)


def encode_words(words: DataFrame, vocabulary) -> DataFrame:
    """(block, numbers, sizes, ids): every distinct word of a bucket encoded once, its ids given to each block that has it."""
    schema = pa.schema([("block", pa.string()), ("numbers", pa.binary()), ("sizes", pa.binary()), ("ids", pa.binary())])

    def run(rows: pa.Table) -> pa.Table:
        t, _ = _tokenizer(vocabulary.value)
        lists = [_unzip(x).split(b"\n") for x in rows["words"].to_pylist()]
        row_of: dict[bytes, int] = {}
        for own in lists:
            for w in own:
                row_of.setdefault(w, len(row_of))
        distinct = list(row_of)
        some_sizes, some_ids = [], []
        for k in range(0, len(distinct), 4096):
            ids = [t.encode(w.decode(), add_special_tokens=False).ids for w in distinct[k : k + 4096]]  # no batch: its threads keep memory each, and a task has one core
            some_sizes.append(np.fromiter(map(len, ids), np.int64, len(ids)))
            some_ids.append(np.fromiter((i for x in ids for i in x), np.uint32, int(some_sizes[-1].sum())))
        size, flat = np.concatenate(some_sizes), np.concatenate(some_ids)
        start = np.cumsum(size) - size
        sizes, found = [], []
        for own in lists:
            at = np.fromiter((row_of[w] for w in own), np.int64, len(own))
            sizes.append(pack(size[at]))
            found.append(pack(flat[_spread(start[at], size[at])]))
        return pa.table([rows["block"], rows["numbers"], pa.array(sizes, pa.binary()), pa.array(found, pa.binary())], schema=schema)

    return words.select("block", "bucket", "numbers", "words").groupBy("bucket").applyInArrow(run, "block string, numbers binary, sizes binary, ids binary")


def _spread(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... (size[0] of them), start[1], ..."""
    total = int(size.sum())
    return np.arange(total) + np.repeat(start - (np.cumsum(size) - size), size)


def _ends(size: np.ndarray) -> np.ndarray:
    """0, size[0], size[0] + size[1], ..."""
    return np.concatenate([[0], np.cumsum(size, dtype=np.int64)])


def _joined(ends: np.ndarray, words: pa.Array) -> pa.Array:
    """The words from each end to the next, joined by blanks."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), words), " ")


def _runs(upto: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Runs of documents with about ``most`` words each, and one document at least."""
    a, n = 0, len(upto) - 1
    while a < n:
        b = min(n, max(a + 1, int(np.searchsorted(upto, upto[a] + most, "right")) - 1))
        yield a, b
        a = b


def join_back(blocks: DataFrame, words: DataFrame, vocabulary, id_type: str) -> DataFrame:
    """(id, n_tokens, ids, decoded): a block's numbers with its words' ids and pieces, by position."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [(np.cumsum(unpack(n), dtype=np.uint32), unpack(s), unpack(i)) for n, s, i in zip(*(right[c].to_pylist() for c in ("numbers", "sizes", "ids")), strict=True)]
        numbers, size, flat = (np.concatenate(x).astype("<u4", copy=False) for x in zip(*parts, strict=True)) if parts else [np.zeros(0, "<u4")] * 3
        row = np.empty(len(numbers), np.uint32)  # by a word's number
        row[numbers] = np.arange(len(numbers), dtype=np.uint32)
        ends = _ends(size)
        said = _joined(ends, _pieces(vocabulary.value).take(pa.array(flat)))  # the join of ids and pieces
        out: list[list[pa.Array]] = [[], [], [], []]
        for docs, counts, own in zip(*(left[c].to_pylist() for c in ("docs", "counts", "numbers")), strict=True):
            out[0].append(pa.ipc.open_stream(_unzip(docs)).read_all()["id"].combine_chunks())
            upto, own = _ends(unpack(counts)), unpack(own)
            for a, b in _runs(upto, STEP):
                words, at = row[own[upto[a] : upto[b]]], upto[a : b + 1] - upto[a]
                found = size[words].astype(np.int64)
                tokens = _ends(found)[at]
                ids = flat[_spread(ends[words], found)]
                out[1].append(pa.array(np.diff(tokens)))
                out[2].append(pa.Array.from_buffers(pa.binary(), b - a, [None, pa.py_buffer((4 * tokens).astype(np.int32)), pa.py_buffer(ids)]))
                out[3].append(_joined(_ends(found > 0)[at], said.take(pa.array(words[found > 0]))))
        types = [out[0][0].type, pa.int64(), pa.binary(), pa.string()]
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks
        return pa.table([pa.chunked_array(x, t) for x, t in zip(out, types, strict=True)], names=["id", "n_tokens", "ids", "decoded"])

    return blocks.groupBy("block").cogroup(words.withColumnRenamed("block", "own_block").groupBy("own_block")).applyInArrow(run, f"id {id_type}, n_tokens long, ids binary, decoded string")


def bpe(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_tokens, ids: little-endian unsigned 32-bit integers, decoded) of each document.

    ``vocabulary``: the tokenizer's JSON, as ``tokenizer_json(path)`` reads it.
    """
    docs = pick(docs, id_col, text_col).toDF("id", "text")
    spark = docs.sparkSession
    vocabulary = vocabulary or tokenizer_json()
    check_vocabulary(vocabulary)
    sent = spark.sparkContext.broadcast(vocabulary)  # one vocabulary file
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = max(BUCKETS_LEAST, parts)  # a bucket of words is a shuffle partition's worth, as the session sizes them
    cut = split_blocks(docs, buckets, block_bytes)
    # bucketed by block: what waits for the words' ids is not shuffled again
    name = f"warden_blocks_{uuid.uuid4().hex}"
    cut.write.option("path", new_path(spark, "blocks")).option("compression", "none").bucketBy(parts, "block").saveAsTable(name)  # its columns are compressed already
    cut = spark.table(name)
    spark.sql(f"DROP TABLE {name}")  # its name only: the files are an external table's
    words = encode_words(cut.where("bucket is not null"), sent)
    return join_back(cut.where("bucket is null").select("block", "docs", "counts", "numbers"), words, sent, docs.schema["id"].dataType.simpleString()).withColumnRenamed("id", id_col)


# --- in plain joins


def pieces_table(spark: SparkSession, vocabulary: str) -> DataFrame:
    """(token, piece): a row for each id of the vocabulary."""
    _, pieces = _tokenizer(vocabulary)
    return spark.createDataFrame(list(enumerate(pieces)), "token int, piece string")


def bpe_rows(docs: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """What ``bpe`` gives, by joins of words, ids and pieces as rows."""
    docs = pick(docs, id_col, text_col).toDF("id", "text")
    vocabulary = vocabulary or tokenizer_json()
    check_vocabulary(vocabulary)
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # one vocabulary file

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, _ = _tokenizer(sent.value)
        for b in batches:
            found = t.encode_batch(b.column(0).to_pylist(), add_special_tokens=False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([e.ids for e in found], pa.list_(pa.int32()))], names=["word", "ids"])

    c = F.col
    text = F.coalesce("text", F.lit(""))
    same = docs.groupBy("id", F.sha2(text, 256).alias("digest")).agg(F.count(F.lit(1)).alias("copies"), F.first(text).alias("text"))
    words = same.select("id", "digest", F.posexplode(F.split("text", "[ \\t\\n\\x0B\\f\\r]+")).alias("at", "word")).where("word <> ''")
    encoded = words.select("word").distinct().mapInArrow(encode, "word string, ids array<int>")
    tokens = words.join(encoded, "word").select("id", "digest", "at", F.posexplode("ids").alias("k", "token")).join(pieces_table(docs.sparkSession, vocabulary), "token")
    rows = tokens.groupBy("id", "digest").agg(F.array_sort(F.collect_list(F.struct("at", "k", "token", "piece"))).alias("rows"))  # one document's tokens
    little = lambda x: F.concat(*[F.lpad(F.hex(F.shiftright(x, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)])
    ids = F.unhex(F.array_join(F.transform("rows", lambda x: little(x["token"])), ""))
    rows = rows.select(c("id").alias("i"), c("digest").alias("d"), F.size("rows").cast("long").alias("n_tokens"), ids.alias("ids"), F.array_join(F.transform("rows", lambda x: x["piece"]), " ").alias("decoded"))
    out = same.join(rows, c("id").eqNullSafe(c("i")) & (c("digest") == c("d")), "left").select("*", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select(c("id").alias(id_col), F.coalesce("n_tokens", F.lit(0).cast("long")).alias("n_tokens"), F.coalesce("ids", F.lit(b"")).alias("ids"), F.coalesce("decoded", F.lit("")).alias("decoded"))
