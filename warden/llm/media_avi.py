"""Media columns: AVI motion-JPEG. Writing, reading by the RIFF index, shots.

A payload is stored losslessly in a baseline (Huffman, 8-bit) gray JPEG by
frame: every byte is one flat 8x8 block, so its DC term alone carries it, with
a quantizer of 8 under which the inverse transform is exact. The frame's own
Huffman table gives a difference of category c a code of 9 - c bits, so a
difference takes 9 bits with its extra bits, and the one-bit code "end of
block" makes it 10. That is a plain JPEG for any decoder, and numpy can pack
and unpack whole frames of it at once. Other baseline frames (any Huffman
tables, AC terms, several components, restart intervals) are decoded too, a
symbol at a time.

Every frame has the same size, 192 bytes of the payload, so the number of frames
grows with the text, and where a shot begins does not depend on the text's length.
Frames are packed and unpacked ``AT_ONCE`` at a time. A media value is about
twice its text and has to stay under the 2 GB that a Spark value can have.

``read_avi`` walks RIFF and takes the frames from ``idx1`` (from ``movi`` where
there is no index). Shots begin where the histogram difference of successive
frames exceeds an adaptive bound (mean and deviation of the differences before
it in the shot).

Defined cases: null and empty texts are payloads of 192 blanks; equal texts
give equal values; null ids are kept; repeated rows give repeated rows; media
that is null, cut off or no AVI gives no frames and no clips.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batch, map_batches, pick

UNIT = 192  # payloads are multiples of it: a frame of 16 x 12 blocks
COLS, ROWS = 16, 12
AT_ONCE = 4096  # frames packed or unpacked together
FPS = 24
BINS = 16
FLOOR, SPREAD = 0.25, 3.0


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b" " * ((-len(raw)) % UNIT or (0 if raw else UNIT))


# --- writing


def _dht(kind: int, lengths: list[int], values: list[int]) -> bytes:
    return b"\xff\xc4" + struct.pack(">HB", 19 + len(values), kind) + bytes(lengths) + bytes(values)


@functools.lru_cache(maxsize=64)
def _jpeg_head(width: int, height: int) -> bytes:
    """Everything before the entropy-coded data of a frame."""
    return b"".join((
        b"\xff\xd8", b"\xff\xdb", struct.pack(">HB", 67, 0), bytes([8] * 64),
        b"\xff\xc0", struct.pack(">HBHHB", 11, 8, height, width, 1), bytes([1, 0x11, 0]),
        _dht(0x00, [1] * 9 + [0] * 7, list(range(8, -1, -1))), _dht(0x10, [1] + [0] * 15, [0]),
        b"\xff\xda", struct.pack(">HB", 8, 1), bytes([1, 0x00, 0, 63, 0]),
    ))


@functools.lru_cache(maxsize=1)
def _codes() -> np.ndarray:
    """Ten bits (difference, then end of block) for each difference from -255 on."""
    d = np.arange(-255, 256)
    cat = np.where(d == 0, 0, np.floor(np.log2(np.maximum(np.abs(d), 1))).astype(int) + 1)
    code = (1 << (9 - cat)) - 2  # 0, 10, 110, ... for the categories 8, 7, 6, ...
    extra = np.where(d > 0, d, d + (1 << cat) - 1)
    return ((code << cat | extra) << 1).astype(np.uint16)


@functools.lru_cache(maxsize=1)
def _values() -> np.ndarray:
    """The difference of each ten bits that ``_codes`` gives."""
    out = np.zeros(1024, np.int16)
    out[_codes()] = np.arange(-255, 256)
    return out


def _pack(frames: np.ndarray) -> np.ndarray:
    """Frames of samples to rows of bytes: four ten-bit codes in five bytes."""
    d = np.diff(frames.astype(np.int16), axis=1, prepend=np.int16(128))
    c = _codes()[d + 255].reshape(len(frames), -1, 4).astype(np.uint64)
    bits = c[..., 0] << 30 | c[..., 1] << 20 | c[..., 2] << 10 | c[..., 3]
    return np.stack([(bits >> s & 255).astype(np.uint8) for s in (32, 24, 16, 8, 0)], axis=-1).reshape(len(frames), -1)


def _unpack(raw: bytes, n: int) -> np.ndarray | None:
    b = np.frombuffer(raw, np.uint8)
    if n % 4 or len(b) < n // 4 * 5:
        return None
    b = b[: n // 4 * 5].reshape(-1, 5).astype(np.uint64)
    bits = b[:, 0] << 32 | b[:, 1] << 24 | b[:, 2] << 16 | b[:, 3] << 8 | b[:, 4]
    c = np.stack([bits >> s & 1023 for s in (30, 20, 10, 0)], axis=-1).reshape(-1)
    return (np.cumsum(_values()[c], dtype=np.int32) + 128).astype(np.uint8)


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def _list(kind: bytes, *chunks: bytes) -> bytes:
    return _chunk(b"LIST", kind + b"".join(chunks))


def write_avi(payload: bytes) -> bytes:
    """An AVI whose frames carry the payload; its length stands in an INFO comment."""
    samples = np.frombuffer(payload + b" " * ((-len(payload)) % UNIT), np.uint8).reshape(-1, UNIT)
    width, height, head = COLS * 8, ROWS * 8, _jpeg_head(COLS * 8, ROWS * 8)
    packed = (r for k in range(0, len(samples), AT_ONCE) for r in _pack(samples[k : k + AT_ONCE]))
    frames = [_chunk(b"00dc", head + r.tobytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9") for r in packed]
    offsets, at = [], 4
    for f in frames:
        offsets.append(at)
        at += len(f)
    index = b"".join(struct.pack("<4sIII", b"00dc", 0x10, o, struct.unpack_from("<I", f, 4)[0]) for o, f in zip(offsets, frames, strict=True))
    largest = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    body = _list(b"hdrl", _chunk(b"avih", avih), _list(b"strl", _chunk(b"strh", strh), _chunk(b"strf", strf)))
    body += _list(b"INFO", _chunk(b"ICMT", b"payload=%d" % len(payload))) + _list(b"movi", *frames) + _chunk(b"idx1", index)
    return _chunk(b"RIFF", b"AVI " + body)


# --- reading


class BadMedia(ValueError):
    """Bytes that are no AVI, or no baseline JPEG."""


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(tag, place of the body, its size) one after the other."""
    while at + 8 <= end:
        tag, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        yield tag, at + 8, min(size, end - at - 8)
        at += 8 + size + (size & 1)


def read_avi(data: bytes | None) -> tuple[dict, list[bytes]]:
    """Stream facts (fps, payload length if noted) and the frames' JPEG bytes."""
    if not data or len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise BadMedia("no AVI")
    facts: dict = {"fps": 0.0, "payload": None}
    movi, index = None, None
    todo = [(12, len(data))]
    while todo:
        for tag, at, size in _chunks(data, *todo.pop()):
            if tag == b"LIST":
                kind = data[at : at + 4]
                if kind == b"movi":
                    movi = (at, size)
                else:
                    todo.append((at + 4, at + size))
            elif tag == b"idx1":
                index = (at, size)
            elif tag == b"strh" and size >= 28 and data[at : at + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", data, at + 20)
                facts["fps"] = rate / scale if scale else 0.0
            elif tag == b"ICMT" and data[at : at + 8] == b"payload=":
                facts["payload"] = int(data[at + 8 : at + size])
    if movi is None:
        raise BadMedia("no movi list")
    frames = []
    if index:
        entries = [struct.unpack_from("<4sIII", data, index[0] + k) for k in range(0, index[1] - 15, 16)]
        # offsets count from the list's kind, or from the file's start in some writers
        base = 0 if entries and data[entries[0][2] : entries[0][2] + 4] == entries[0][0] and entries[0][2] >= movi[0] else movi[0]
        frames = [data[base + o + 8 : base + o + 8 + n] for tag, _, o, n in entries if tag[2:] in (b"dc", b"db")]
    else:
        frames = [data[a : a + n] for tag, a, n in _chunks(data, movi[0] + 4, movi[0] + movi[1]) if tag[2:] in (b"dc", b"db")]
    return facts, frames


#: The zigzag order of the JPEG standard.
ZIGZAG = (
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
)


@functools.lru_cache(maxsize=256)
def _parsed(head: bytes) -> dict:
    """What the segments before the scan's data say."""
    out: dict = {"quant": {}, "huff": {}, "restart": 0}
    at = 2
    while at + 4 <= len(head):
        if head[at] != 0xFF:
            raise BadMedia("no marker")
        mark, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + size]
        if mark == 0xDB:
            while body:
                wide = body[0] >> 4
                n = 128 if wide else 64
                out["quant"][body[0] & 15] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[1 + n :]
        elif mark == 0xC4:
            while body:
                lengths = body[1:17]
                n = sum(lengths)
                out["huff"][body[0]] = (lengths, body[17 : 17 + n])
                body = body[17 + n :]
        elif mark in (0xC0, 0xC1):
            _, out["height"], out["width"], n = struct.unpack_from(">BHHB", body)
            out["parts"] = [(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
        elif 0xC2 <= mark <= 0xCF and mark not in (0xC8, 0xCC):
            raise BadMedia("not baseline")
        elif mark == 0xDD:
            out["restart"] = struct.unpack_from(">H", body)[0]
        elif mark == 0xDA:
            out["scan"] = [(body[1 + 2 * k], body[2 + 2 * k] >> 4, body[2 + 2 * k] & 15) for k in range(body[0])]
        at += 2 + size
    if "parts" not in out or "scan" not in out:
        raise BadMedia("no frame")
    dc, ac = out["huff"].get(0, (b"", b"")), out["huff"].get(16, (b"", b""))
    out["flat"] = len(out["parts"]) == 1 and dc == (bytes([1] * 9 + [0] * 7), bytes(range(8, -1, -1))) and ac == (bytes([1] + [0] * 15), b"\0") and not out["restart"]
    return out


def _split(jpeg: bytes) -> tuple[bytes, bytes]:
    """The segments up to the scan's header, and the data after it."""
    if jpeg[:2] != b"\xff\xd8":
        raise BadMedia("no JPEG")
    at = 2
    while at + 4 <= len(jpeg):
        mark, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        at += 2 + size
        if mark == 0xDA:
            return jpeg[:at], jpeg[at : -2 if jpeg[-2:] == b"\xff\xd9" else None]
    raise BadMedia("no scan")


def decode_dc(jpeg: bytes) -> np.ndarray:
    """The frame's first component at one sample by block: rounded block means, rows by columns."""
    head, data = _split(jpeg)
    facts = _parsed(head)
    rows, cols = -(-facts["height"] // 8), -(-facts["width"] // 8)
    if facts["flat"] and int(facts["quant"][facts["parts"][0][3]][0]) == 8:
        flat = _unpack(data.replace(b"\xff\0", b"\xff"), rows * cols)
        if flat is None:
            raise BadMedia("cut off")
        return flat.reshape(rows, cols)
    full = decode(jpeg)
    full = np.pad(full, ((0, rows * 8 - full.shape[0]), (0, cols * 8 - full.shape[1])), "edge")
    return np.clip(np.rint(full.reshape(rows, 8, cols, 8).mean(axis=(1, 3))), 0, 255).astype(np.uint8)


def decode_all(frames: list[bytes]) -> list[np.ndarray] | np.ndarray:
    """``decode_dc`` of every frame; frames of one flat header are unpacked together."""
    split = [_split(f) for f in frames]
    if split and len({head for head, _ in split}) == 1 and (facts := _parsed(split[0][0]))["flat"]:
        rows, cols = -(-facts["height"] // 8), -(-facts["width"] // 8)
        bodies = [data.replace(b"\xff\0", b"\xff") for _, data in split]
        size = rows * cols // 4 * 5
        if rows * cols % 4 == 0 and int(facts["quant"][facts["parts"][0][3]][0]) == 8 and all(len(b) == size for b in bodies):
            out = np.empty((len(frames), rows, cols), np.uint8)
            for k in range(0, len(frames), AT_ONCE):
                part = bodies[k : k + AT_ONCE]
                b = np.frombuffer(b"".join(part), np.uint8).reshape(-1, 5).astype(np.uint64)
                bits = b[:, 0] << 32 | b[:, 1] << 24 | b[:, 2] << 16 | b[:, 3] << 8 | b[:, 4]
                c = np.stack([bits >> s & 1023 for s in (30, 20, 10, 0)], axis=-1).reshape(len(part), -1)
                out[k : k + AT_ONCE] = (np.cumsum(_values()[c], axis=1, dtype=np.int32) + 128).astype(np.uint8).reshape(-1, rows, cols)
            return out
    return [decode_dc(f) for f in frames]


def _tree(lengths: bytes, values: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for size, n in enumerate(lengths, 1):
        for _ in range(n):
            out[size, code] = values[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


@functools.lru_cache(maxsize=1)
def _basis() -> np.ndarray:
    k = np.arange(8)
    m = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) / 2
    m[0] /= np.sqrt(2)
    return m


class _Bits:
    def __init__(self, data: bytes):
        self.bits = int.from_bytes(data.replace(b"\xff\0", b"\xff"), "big")
        self.left = len(data.replace(b"\xff\0", b"\xff")) * 8

    def take(self, n: int) -> int:
        self.left -= n
        if self.left < 0:
            raise BadMedia("cut off")
        return self.bits >> self.left & ((1 << n) - 1)

    def symbol(self, tree: dict[tuple[int, int], int]) -> int:
        code = 0
        for size in range(1, 17):
            code = code << 1 | self.take(1)
            if (size, code) in tree:
                return tree[size, code]
        raise BadMedia("no such code")

    def signed(self, n: int) -> int:
        v = self.take(n) if n else 0
        return v if not n or v >> (n - 1) else v - (1 << n) + 1


def _sections(data: bytes) -> list[bytes]:
    """Entropy-coded data between restart markers."""
    out, at, k = [], 0, 0
    while (k := data.find(b"\xff", k)) >= 0 and k + 1 < len(data):
        if 0xD0 <= data[k + 1] <= 0xD7:
            out.append(data[at:k])
            at = k + 2
        k += 2
    return [*out, data[at:]]


def decode(jpeg: bytes) -> np.ndarray:
    """Any baseline frame, decoded whole: the first component's samples."""
    head, data = _split(jpeg)
    facts = _parsed(head)
    parts = {p[0]: p for p in facts["parts"]}
    hmax, vmax = max(p[1] for p in facts["parts"]), max(p[2] for p in facts["parts"])
    one = len(facts["scan"]) == 1
    across, down = -(-facts["width"] // (8 * (1 if one else hmax))), -(-facts["height"] // (8 * (1 if one else vmax)))
    trees = {k: _tree(*v) for k, v in facts["huff"].items()}
    first = facts["parts"][0][0]
    h0, v0 = (1, 1) if one else parts[first][1:3]
    plane = np.zeros((down * v0 * 8, across * h0 * 8))
    sections = _sections(data) if facts["restart"] else [data]
    step, mcu = facts["restart"] or across * down, 0
    for section in sections:
        bits, last = _Bits(section), dict.fromkeys(parts, 0)
        for mcu in range(mcu, min(mcu + step, across * down)):
            y, x = divmod(mcu, across)
            for ident, dc, ac in facts["scan"]:
                _, h, v, q = parts[ident]
                for k in range(1 if one else h * v):
                    coef = np.zeros(64)
                    last[ident] += bits.signed(bits.symbol(trees[dc]))
                    coef[0], i = last[ident], 1
                    while i < 64:
                        s = bits.symbol(trees[16 + ac])
                        if not s:
                            break
                        i += s >> 4
                        if s & 15 and i < 64:
                            coef[ZIGZAG[i]] = bits.signed(s & 15)
                        i += 1
                    if ident == first:
                        quant = np.zeros(64)
                        quant[list(ZIGZAG)] = facts["quant"][q]
                        block = _basis().T @ (coef * quant).reshape(8, 8) @ _basis() + 128
                        r, c = ((y, x) if one else (y * v + k // h, x * h + k % h))
                        plane[r * 8 : r * 8 + 8, c * 8 : c * 8 + 8] = block
        mcu += 1
    height = -(-facts["height"] * v0 // (1 if one else vmax))
    width = -(-facts["width"] * h0 // (1 if one else hmax))
    return np.clip(np.rint(plane[:height, :width]), 0, 255).astype(np.uint8)


def histograms(frames: list[np.ndarray] | np.ndarray) -> np.ndarray:
    """Shares of ``BINS`` equal bins, a row for each frame."""
    if isinstance(frames, np.ndarray):
        out = np.empty((len(frames), BINS))
        for k in range(0, len(frames), AT_ONCE):
            part = frames[k : k + AT_ONCE]
            cells = (part.reshape(len(part), -1) >> 4) + (np.arange(len(part)) * BINS)[:, None]
            out[k : k + AT_ONCE] = np.bincount(cells.reshape(-1), minlength=len(part) * BINS).reshape(len(part), BINS) / frames[0].size
        return out
    return np.array([np.bincount(f.reshape(-1) >> 4, minlength=BINS) / f.size for f in frames])


def shots(frames: list[np.ndarray] | np.ndarray) -> list[int]:
    """Numbers of the frames at which a shot begins (0 included)."""
    if not len(frames):
        return []
    bins = histograms(frames)
    diff = np.abs(np.diff(bins, axis=0)).sum(axis=1) / 2
    out, n, total, square = [0], 0, 0.0, 0.0
    for k, d in enumerate(diff.tolist(), 1):
        mean = total / n if n else 0.0
        bound = max(FLOOR, mean + SPREAD * max(0.0, square / n - mean * mean) ** 0.5) if n else FLOOR
        if d > bound:
            out.append(k)
            n, total, square = 0, 0.0, 0.0
        else:
            n, total, square = n + 1, total + d, square + d * d
    return out


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's payload as an AVI."""
    docs = pick(docs, id_col, text_col)

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        step = 512  # so that the media of a few rows is held at once
        for k in range(0, b.num_rows, step):
            rows = [padded(t) for t in b.column(1).slice(k, step).to_pylist()]
            schema = pa.schema([b.schema.field(0), ("n_bytes", pa.int64()), ("media", pa.binary())])
            yield batch(schema, b.column(0).slice(k, step), [n for n, _ in rows], [write_avi(p) for _, p in rows])

    return map_batches(docs, run, f"`{id_col}` {docs.schema[0].dataType.simpleString()}, n_bytes long, media binary")


def _clip(no: int, a: int, b: int, fps: float, means: list[float]) -> dict:
    mean = sum(means[a:b]) / (b - a)
    return {"clip": no, "first_frame": a, "n_frames": b - a, "start_s": round(a / fps, 6) if fps else None, "end_s": round(b / fps, 6) if fps else None, "brightness": round(mean, 4)}


_CLIP = (("clip", pa.int64(), "long"), ("first_frame", pa.int64(), "long"), ("n_frames", pa.int64(), "long"), ("start_s", pa.float64(), "double"), ("end_s", pa.float64(), "double"), ("brightness", pa.float64(), "double"))


def read_media(data: bytes | None) -> tuple[bytes | None, list[dict]]:
    """The payload (null if the media is broken) and the clips."""
    try:
        facts, frames = read_avi(data)
        planes = decode_all(frames)
    except (BadMedia, struct.error, IndexError, KeyError, ValueError):
        return None, []
    begin = [*shots(planes), len(planes)]
    payload = b"".join(p.tobytes() for p in planes)[: facts["payload"]]
    means = planes.mean(axis=(1, 2)).tolist() if isinstance(planes, np.ndarray) else [float(p.mean()) for p in planes]
    return payload, [_clip(i, a, b, facts["fps"], means) for i, (a, b) in enumerate(zip(begin, begin[1:], strict=False))]


def read(df: DataFrame, media_col: str = "media", keep: tuple[str, ...] = ("doc_id", "n_bytes")) -> DataFrame:
    """``keep``, facts about the stored and the read-back bytes, and ``clips``: one struct for each timed clip."""
    df = pick(df, *keep, media_col)
    clip = pa.list_(pa.struct([(n, t) for n, t, _ in _CLIP]))

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        raw = b.column(len(keep)).to_pylist()
        rows = [read_media(m) for m in raw]
        some = [p or b"" for p, _ in rows]
        schema = pa.schema([*list(b.schema)[: len(keep)], ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("clips", clip)])
        yield batch(
            schema, *b.columns[: len(keep)], [None if p is None else len(p) for p, _ in rows], [hashlib.sha256(p).hexdigest() for p in some], [zlib.crc32(p[-16:]) for p in some],
            [None if m is None else len(m) for m in raw], [hashlib.sha256(m or b"").hexdigest() for m in raw], [c for _, c in rows],
        )

    named = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep)
    clips = ",".join(f"{n}:{t}" for n, _, t in _CLIP)
    return map_batches(df, run, f"{named}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips array<struct<{clips}>>")


def clips(df: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """One row for each timed clip of each media row."""
    return read(df, media_col, (id_col,)).selectExpr(f"`{id_col}`", "inline(clips)")
