import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lodevec.llm import gif_media as G
from lodevec.llm.queries import op1_gif_media


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000), st.sampled_from([2, 4, 8]))
def test_code_streams_round_trip(data, root):
    samples = bytes(b & ((1 << root) - 1) for b in data)
    assert G.lzw_unpack(G.lzw_pack(samples, root), root, len(samples) + 5) == samples


def test_a_full_table_stays_in_use():
    samples = np.random.default_rng(1).integers(0, 256, 60_000).astype(np.uint8).tobytes()
    assert G.lzw_unpack(G.lzw_pack(samples), 8, 10**6) == samples


def test_clear_codes_inside_a_stream():
    # two packed streams without the first one's end code: 9-bit codes clear 65 66 clear 67 end
    codes = [256, 65, 66, 256, 67, 257]
    bits = "".join(f"{c:09b}"[::-1] for c in codes)
    data = bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))
    assert G.lzw_unpack(data, 8, 10) == b"ABC"


def test_broken_stream_gives_what_it_has():
    packed = G.lzw_pack(b"abcabcabc" * 50)
    assert (b"abcabcabc" * 50).startswith(G.lzw_unpack(packed[: len(packed) // 2], 8, 10**4))


def _two_colours(disposal, transparent=None):
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    pictures = [
        {"samples": bytes([1] * 16), "disposal": disposal, "delay_cs": 5},
        {"samples": bytes([2, 3, 3, 2]), "box": (1, 1, 2, 2), "transparent": transparent, "disposal": disposal},
        {"samples": bytes([3]), "box": (0, 0, 1, 1)},
    ]
    return G.decode(G.encode(4, 4, pictures, palette))


def test_disposal_and_transparency():
    kept = _two_colours(1, transparent=3)
    assert kept[1].rgba[1, 1, :3].tolist() == [0, 255, 0] and kept[1].rgba[1, 2, :3].tolist() == [255, 0, 0]
    cleared = _two_colours(2)
    assert cleared[1].rgba[0, 0, 3] == 0 and cleared[2].rgba[1, 1, 3] == 0
    restored = _two_colours(3)
    assert restored[1].rgba[0, 0, 3] == 0 and restored[2].rgba[3, 3, 3] == 0
    assert [f.start_ms for f in kept] == [0, 50, 90]


def test_local_palette_and_interlace():
    samples = bytes(range(64))
    palette = bytes(range(192))
    (frame,) = G.decode(G.encode(8, 8, [{"samples": samples, "palette": palette, "interlaced": True}], bytes(6)))
    assert frame.indices.tobytes() == samples and frame.rgba[0, 1, :3].tolist() == [3, 4, 5]


def test_histogram_counts_visible_pixels():
    x = np.zeros((2, 2, 4), np.uint8)
    x[0, 0] = [255, 32, 0, 255]
    counts = G.histogram(x)
    assert sum(counts) == 3 and counts[7] == 1 and counts[8 + 1] == 1 and counts[16] == 1


def test_no_gif():
    with pytest.raises(ValueError):
        G.decode(b"PNG")


def _expected(text):
    raw = (text or "").encode()
    payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
    return len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])


def test_texts_against_brute_force(docs, no_docs):
    rows = G.read_texts(G.store_texts(docs)).collect()
    given_ = docs.collect()
    assert len(rows) == len(given_)
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    assert sorted(((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows), key=key) == sorted(((d.doc_id, *_expected(d.text)) for d in given_), key=key)
    same = [r for r in rows if r.doc_id == 8]
    assert len(same) == 2 and same[0] == same[1]
    assert all([f.start_ms for f in r.frames] == [40 * n for n in range(len(r.frames))] and sum(sum(f.histogram) for f in r.frames) == 3 * r.payload_bytes for r in rows)
    assert max(len(r.frames) for r in rows) > 4
    assert G.read_texts(G.store_texts(no_docs)).count() == 0


def test_frames_of_media(spark):
    media = [(1, bytearray(G.store_payload(b"a" * 576 * 300))), (2, None), (3, bytearray(b"no gif"))]
    rows = G.frames(spark.createDataFrame(media, "doc_id long, media binary")).orderBy("frame_no").collect()
    assert [(r.doc_id, r.frame_no, r.start_ms) for r in rows] == [(1, n, 40 * n) for n in range(5)]
    assert sum(rows[0].histogram) == 3 * 576 * 64
    huge = b"GIF89a" + struct.pack("<HHBBB", 30_000, 30_000, 0x80, 0, 0) + bytes(6) + b"\x3b"
    wide = b"GIF89a" + struct.pack("<HHBBB", 4, 4, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 60_000, 60_000, 0) + b"\x02\x00\x3b"
    assert G.frames(spark.createDataFrame([(1, bytearray(huge)), (2, bytearray(wide))], "doc_id long, media binary")).count() == 0


@settings(max_examples=30, deadline=None)
@given(st.binary(min_size=1, max_size=40), st.integers(1, 300), st.integers(0, 3))
def test_payloads_with_transparency_and_disposal_round_trip(seed, rows, noise):
    rng = np.random.default_rng(len(seed))
    payload = np.resize(np.frombuffer(seed, np.uint8), rows * 576).copy()
    payload[rng.integers(0, len(payload), noise * 500)] = rng.integers(0, 256, noise * 500)
    assert G.read_payload(G.shots(G.store_payload(payload.tobytes()))) == payload.tobytes()


def test_stored_frames_use_palettes_transparency_and_disposal():
    payload = b"abcdefgh" * (576 * 64 * 3 // 8)
    data = G.store_payload(payload)
    frames = G.decode(data)
    assert len(frames) == 3 and G.read_payload(frames) == payload
    assert (frames[1].indices == 255 - G.FREE).all() and (frames[2].indices == G.FREE).all()  # all is as it was beneath
    assert (frames[1].rgba == frames[0].rgba).all() and len(data) < 60_000


def test_query(spark, sf_dir):
    rows = {r.doc_id: r for r in op1_gif_media(spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(rows) == len(docs)
    assert all((r := rows[d.doc_id]) and (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == _expected(d.text) for d in docs)
