"""AVI round trips and decoders; chat renderings."""

import struct
import zlib

import numpy as np

from warden.llm import chat_format, media_avi


def test_round_trip(awkward, nothing):
    rows = media_avi.read(media_avi.media(awkward)).collect()
    texts = {}
    for r in awkward.collect():
        texts[r["doc_id"]] = r["text"]
    assert len(rows) == awkward.count()
    for r in rows:
        n, payload = media_avi.padded(texts[r["doc_id"]])
        assert len(payload) % 192 == 0 and len(payload) > 0
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (n, len(payload), zlib.crc32(payload[-16:]))
        assert media_avi.read_media(media_avi.write_avi(payload))[0] == payload
        assert sum(c["n_frames"] for c in r["clips"]) > 0
    assert media_avi.read(media_avi.media(nothing)).count() == 0


def test_all_bytes_survive():
    rng = np.random.default_rng(0)
    for size in (192, 192 * 7, 192 * 48, 192 * 49, 192 * 500):
        p = rng.integers(0, 256, size, dtype=np.uint8).tobytes()
        assert media_avi.read_media(media_avi.write_avi(p))[0] == p


def test_fast_and_general_decoders_agree():
    p = bytes(range(192))
    _, frames = media_avi.read_avi(media_avi.write_avi(p))
    full = media_avi.decode(frames[0])
    assert full.shape == (96, 128) and (full.reshape(12, 8, 16, 8) == media_avi.decode_dc(frames[0])[:, None, :, None]).all()


def test_general_decoder_reads_ac_terms():
    """A frame with one AC term, coded by hand with plain tables."""
    head = b"\xff\xd8" + b"\xff\xdb" + struct.pack(">HB", 67, 0) + bytes([1] * 64) + b"\xff\xc0" + struct.pack(">HBHHB", 11, 8, 8, 8, 1) + bytes([1, 0x11, 0])
    head += media_avi._dht(0, [0, 2] + [0] * 14, [0, 3]) + media_avi._dht(16, [0, 2] + [0] * 14, [0, 3]) + b"\xff\xda" + struct.pack(">HB", 8, 1) + bytes([1, 0, 0, 63, 0])
    bits = "01" + "101" + "01" + "111" + "00"  # DC 5, AC(1) 7, end
    data = int(bits + "1" * (-len(bits) % 8), 2).to_bytes(-(-len(bits) // 8), "big")
    got = media_avi.decode(head + data + b"\xff\xd9")
    k = np.arange(8)
    want = 128 + 5 / 8 + 7 / 8 * np.sqrt(2) * np.cos((2 * k + 1) * np.pi / 16)
    assert (got == np.rint(want)[None, :]).all()


def test_index_and_broken_media():
    p = b"ab" * 960
    avi = media_avi.write_avi(p)
    no_index = avi[: avi.rindex(b"idx1")]
    assert media_avi.read_media(no_index)[0] == p
    for bad in (None, b"", b"RIFF", avi[:40], b"x" * 100):
        assert media_avi.read_media(bad) == (None, [])
    for k in range(0, len(avi), 97):
        media_avi.read_media(avi[:k])  # never raises


def test_shots_are_found():
    dark, light = np.full((12, 16), 20, np.uint8), np.full((12, 16), 200, np.uint8)
    assert media_avi.shots([dark] * 5 + [light] * 4 + [dark] * 3) == [0, 5, 9]
    assert media_avi.shots([]) == [] and media_avi.shots([dark] * 4) == [0]


def test_long_texts_keep_the_frame_size():
    """Over 7 MB, and a shot change that frames of a growing size would average away."""
    p = np.random.default_rng(1).integers(0, 256, 192 * 40_000, dtype=np.uint8).tobytes()
    assert len(p) > 7_000_000
    avi = media_avi.write_avi(p)
    _, frames = media_avi.read_avi(avi)
    assert len(frames) == 40_000 and media_avi.decode_dc(frames[-1]).shape == (12, 16)
    payload, clips = media_avi.read_media(avi)
    assert payload == p and sum(c["n_frames"] for c in clips) == 40_000


def test_shots_do_not_depend_on_what_follows():
    short, long = b"\x14" * 192 * 5 + b"\xc8" * 192 * 4, b"\x14" * 192 * 3000
    assert [c["first_frame"] for c in media_avi.read_media(media_avi.write_avi(short))[1]] == [0, 5]
    assert [c["first_frame"] for c in media_avi.read_media(media_avi.write_avi(short + long))[1]] == [0, 5, 9]


def test_chat(frame, spark):
    rows = [(1, 0, "system", "be kind", "x"), (1, 1, "ann", "hi", "x"), (1, 2, "bob", "yo 漢", "x"), (1, 3, "ann", None, "x"), (2, 0, "system", "alone", "x"), (3, 40, "ann", "late", "x"), (3, 1, "bob", "early", "x"), (3, 1, "bob", "early", "x"), (None, 1, "ann", "lost", "x"), (4, None, "ann", "lost", "x")]
    out = chat_format.render(frame(rows, "conv_id long, turn int, role string, text string, perspective string")).collect()
    by = {(r["conv_id"], r["perspective"], r["segment"]): r for r in out}
    assert set(by) == {(1, "ann", 0), (1, "bob", 0), (3, "ann", 0), (3, "ann", 1), (3, "bob", 0), (3, "bob", 1)}
    a = by[1, "ann", 0]
    assert a["rendered"] == "<|system|>\nbe kind<|end|>\n<|assistant|>\nhi<|end|>\n<|user name=bob|>\nyo 漢<|end|>\n<|assistant|>\n<|end|>\n"
    assert [a["rendered"][slice(*map(int, s.split("-")))] for s in a["mask"].split(",")] == ["hi<|end|>", "<|end|>"] and a["n_trained"] == 2 and a["trained_chars"] == 16
    assert by[3, "bob", 0]["n_turns"] == 2 and by[3, "bob", 1]["mask"] == ""
    assert chat_format.render(spark.createDataFrame([], "conv_id long, turn int, role string, text string")).count() == 0
