"""GIF media columns: LZW code streams, palettes, transparency, disposal, timed frames, colour histograms.

``store_payload`` puts bytes into an animated GIF, one byte a pixel: frames differ in palette and disposal, and a pixel that
shows what lies beneath is transparent. ``shots`` reads any GIF87a/89a back into composited frames, one at a
time. ``frames`` is the DataFrame operator that turns a binary GIF column into one row a frame; ``read_texts``
gives payload digests with the timed frames as a column.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.llm.common import map_rows, schema_of, text_or_empty

WIDTH = 576
ROWS = 64  # of a frame at most
#: A canvas of more pixels isn't decoded: four bytes each are held at a time.
MOST_PIXELS = 1 << 24
DELAY_CS = 4
HIST_BINS = 8  # of each colour channel

TABLE_FULL = 4096


@lru_cache
def _widths(root: int) -> np.ndarray:
    """Bits of the n-th code after a clear code; the table gains one entry a code from the second on."""
    first = (1 << root) + 2
    entries = np.arange(first - 1, TABLE_FULL)
    entries[0] = first
    return np.clip(np.floor(np.log2(entries)).astype(np.int64) + 1, root + 1, 12)


def lzw_pack(samples: bytes, root: int = 8) -> bytes:
    """Compress samples below ``2**root`` into a GIF code stream that starts with clear and ends with end.

    A full table stays in use to the end of the picture (a deferred clear).
    """
    clear, end = 1 << root, (1 << root) + 1
    codes = [clear]
    emit = codes.append
    known: dict[int, int] = {}
    free = end + 1
    if samples:
        feed = iter(samples)
        run = next(feed)
        find = known.get
        for sample in feed:
            key = run << 8 | sample
            longer = find(key)
            if longer is not None:
                run = longer
                continue
            emit(run)
            if free < TABLE_FULL:
                known[key] = free
                free += 1
            run = sample
        emit(run)
    emit(end)
    values = np.asarray(codes, dtype=np.uint16)
    widths = np.full(len(values), 12, dtype=np.uint8)
    schedule = _widths(root)[: len(values) - 1]
    widths[0] = root + 1
    widths[1 : 1 + len(schedule)] = schedule
    bits = np.unpackbits(values.astype("<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[_LANES[None, :] < widths[:, None]], bitorder="little").tobytes()


_LANES = np.arange(16, dtype=np.uint8)


def lzw_unpack(stream: bytes, root: int, limit: int) -> bytes:
    """Decode a GIF code stream to at most ``limit`` samples. A stream that breaks off gives what it has."""
    clear, end = 1 << root, (1 << root) + 1
    schedule = _widths(root)
    total = len(stream) * 8
    raw = np.frombuffer(stream + b"\0" * 4, dtype=np.uint8).astype(np.uint32)
    words = raw[:-3] | raw[1:-2] << 8 | raw[2:-1] << 16
    singles = [bytes([i]) for i in range(clear)] + [b"", b""]
    out: list[bytes] = []
    made, at, place = 0, 0, 0  # samples so far, bit, codes since the last clear
    entries = list(singles)
    last = b""
    while made < limit:
        # all codes up to the place where the table is full, or after it a run of 12-bit codes
        widths = schedule[place:] if place < len(schedule) else np.full(1 << 16, 12)
        edges = at + np.concatenate(([0], np.cumsum(widths)))
        whole = int(np.searchsorted(edges, total, side="right")) - 1
        if whole <= 0:
            break
        starts = edges[:whole]
        codes = words[starts >> 3] >> (starts & 7).astype(np.uint32) & ((1 << widths[:whole]) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        n = int(stops[0]) if len(stops) else whole
        begin = len(out)
        if len(entries) == TABLE_FULL:
            out += map(entries.__getitem__, codes[:n].tolist())
        else:
            add, grow = out.append, entries.append
            for code in codes[:n].tolist():
                if code < len(entries):
                    entry = entries[code]
                elif last:
                    entry = last + last[:1]
                else:
                    return b"".join(out)[:limit]
                if last and len(entries) < TABLE_FULL:
                    grow(last + entry[:1])
                add(entry)
                last = entry
        made += sum(map(len, out[begin:]))
        if not len(stops):
            at, place = int(edges[whole]), place + whole
        elif codes[n] == end:
            break
        else:
            at, place, last, entries = int(edges[n + 1]), 0, b"", list(singles)
    return b"".join(out)[:limit]


@dataclass
class Frame:
    """One composited picture. ``rgba`` is the whole canvas, ``indices`` the samples of the frame's own box.

    ``shots`` draws on one canvas, so there ``rgba`` is good until the next frame is asked for.
    """

    start_ms: int
    delay_ms: int
    box: tuple[int, int, int, int]
    rgba: np.ndarray
    indices: np.ndarray


GREY = np.repeat(np.arange(256, dtype=np.uint8), 3).tobytes()


def _blocks(data: bytes) -> bytes:
    parts = [bytes([len(data[i : i + 255])]) + data[i : i + 255] for i in range(0, len(data), 255)]
    return b"".join(parts) + b"\0"


def encode(
    width: int, height: int, pictures: list[dict], palette: bytes, loop: bool = True
) -> bytes:
    """Build a GIF89a. A picture has ``samples`` and may have box, delay_cs, disposal, transparent, palette, interlaced."""
    depth = max(1, (len(palette) // 3 - 1).bit_length())
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x80 | (depth - 1) << 4 | (depth - 1), 0, 0)]
    out.append(palette.ljust(3 << depth, b"\0"))
    if loop:
        out.append(b"\x21\xff\x0bNETSCAPE2.0\x03\x01\x00\x00\x00")
    for p in pictures:
        x, y, w, h = p.get("box", (0, 0, width, height))
        clear = p.get("transparent")
        out.append(struct.pack("<BBBBHBB", 0x21, 0xF9, 4, p.get("disposal", 1) << 2 | (clear is not None), p.get("delay_cs", DELAY_CS), clear or 0, 0))
        own = p.get("palette")
        flags = 0
        if own is not None:
            bits = max(1, (len(own) // 3 - 1).bit_length())
            flags, own = 0x80 | (bits - 1), own.ljust(3 << bits, b"\0")
        samples = p["samples"]
        if p.get("interlaced"):
            rows = np.frombuffer(samples, np.uint8).reshape(h, w)
            samples, flags = rows[_interlaced(h)].tobytes(), flags | 0x40
        out.append(struct.pack("<BHHHHB", 0x2C, x, y, w, h, flags) + (own or b""))
        root = max(2, depth if own is None else bits)
        out.append(bytes([root]) + _blocks(lzw_pack(samples, root)))
    return b"".join(out) + b"\x3b"


def _interlaced(height: int) -> np.ndarray:
    """Row numbers in the order in which an interlaced picture stores them."""
    return np.concatenate([np.arange(a, height, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes) -> list[Frame]:
    """All frames of a GIF, each with a canvas of its own."""
    return [replace(f, rgba=f.rgba.copy()) for f in shots(data)]


def shots(data: bytes) -> Iterator[Frame]:
    """The frames of a GIF, composited. Raises ``ValueError`` on anything that is no GIF or has too large a canvas."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack("<HHBBB", data[6:13])
    if width * height > MOST_PIXELS:
        raise ValueError("too large a canvas")
    at = 13
    common = None
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        common = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3)
        at += n
    canvas = np.zeros((height, width, 4), np.uint8)
    clock, delay, disposal, clear = 0, 0, 0, None

    def chunks() -> bytes:
        nonlocal at
        parts = []
        while at < len(data) and (n := data[at]):
            parts.append(data[at + 1 : at + 1 + n])
            at += 1 + n
        at += 1
        return b"".join(parts)

    while at < len(data) and data[at] != 0x3B:
        kind = data[at]
        if kind == 0x21:
            label = data[at + 1]
            at += 2
            body = chunks()
            if label == 0xF9 and len(body) >= 4:
                packed, delay, index = struct.unpack("<BHB", body[:4])
                disposal, clear = packed >> 2 & 7, index if packed & 1 else None
        elif kind == 0x2C:
            x, y, w, h, flags = struct.unpack("<HHHHB", data[at + 1 : at + 10])
            if w * h > MOST_PIXELS:
                raise ValueError("too large a frame")
            at += 10
            colours = common
            if flags & 0x80:
                n = 3 << (flags & 7) + 1
                colours = np.frombuffer(data[at : at + n], np.uint8).reshape(-1, 3)
                at += n
            if colours is None:
                raise ValueError("a picture without palette")
            root = data[at]
            at += 1
            raw = lzw_unpack(chunks(), root, w * h)
            indices = np.frombuffer(raw.ljust(w * h, b"\0"), np.uint8).reshape(h, w)
            if flags & 0x40:
                rows = np.empty_like(indices)
                rows[_interlaced(h)] = indices
                indices = rows
            before = canvas.copy() if disposal == 3 else None
            right, low = min(width, x + w), min(height, y + h)
            shown = indices[: max(0, low - y), : max(0, right - x)]
            lut = np.zeros((256, 4), np.uint8)
            lut[: len(colours), :3] = colours
            lut[:, 3] = 255
            box = canvas.view(np.uint32)[y:low, x:right, 0]
            painted = lut.view(np.uint32)[:, 0][shown]
            if clear is None:
                box[...] = painted
            else:
                np.copyto(box, painted, where=shown != clear)
            yield Frame(clock, delay * 10, (x, y, w, h), canvas, indices)
            clock += delay * 10
            if disposal == 2:
                box[...] = 0
            elif before is not None:
                canvas = before
            delay, disposal, clear = 0, 0, None
        else:
            raise ValueError(f"unknown block {kind:#x}")


def histogram(pixels: np.ndarray) -> list[int]:
    """Counts of 8 bins of red, then green, then blue, over pixels that aren't transparent."""
    flat = np.ascontiguousarray(pixels).view("<u4").ravel()
    joint = (flat >> 5 & 7) | (flat >> 10 & 0x38) | (flat >> 15 & 0x1C0) | (flat >> 24 == 0).astype(np.uint32) << 9
    cube = np.bincount(joint, minlength=1024)[:512].reshape(HIST_BINS, HIST_BINS, HIST_BINS)
    return [*cube.sum((0, 1)).tolist(), *cube.sum((0, 2)).tolist(), *cube.sum((1, 2)).tolist()]


NEGATIVE = np.repeat(np.arange(255, -1, -1, dtype=np.uint8), 3).tobytes()
_INVERTED = bytes(range(255, -1, -1))
#: A byte that UTF-8 never has; its palette place stands for transparency where the payload doesn't have it either.
FREE = 254


def store_payload(payload: bytes) -> bytes:
    """A payload of whole rows of 576 bytes as frames of up to 64 rows; the last one may be lower.

    Shades of grey are the bytes. Every second frame has a local palette of negative shades and is taken off
    the canvas when it is over. Pixels that show the same as what they cover are transparent.
    """
    rows = len(payload) // WIDTH
    step = WIDTH * ROWS
    free = FREE not in payload
    beneath = b""  # what the canvas shows before a frame
    pictures = []
    for n, i in enumerate(range(0, len(payload), step)):
        part = payload[i : i + step]
        shown = part
        if free and beneath:
            fresh, old = np.frombuffer(part, np.uint8), np.frombuffer(beneath, np.uint8, len(part))
            shown = np.where(fresh == old, np.uint8(FREE), fresh).tobytes()
        odd = n % 2 == 1
        picture = {"samples": shown.translate(_INVERTED) if odd else shown, "box": (0, 0, WIDTH, len(part) // WIDTH), "disposal": 3 if odd else 1}
        if odd:
            picture["palette"] = NEGATIVE
        if free:
            picture["transparent"] = 255 - FREE if odd else FREE
        pictures.append(picture)
        beneath = beneath if odd else part + beneath[len(part) :]
    return encode(WIDTH, min(ROWS, rows), pictures, GREY)


def read_payload(frames: Iterable[Frame]) -> bytes:
    """What ``store_payload`` put in: the red samples of each frame's box, as composited."""
    return b"".join(f.rgba[y : y + h, x : x + w, 0].tobytes() for f in frames for x, y, w, h in [f.box])


def padded(data: bytes) -> bytes:
    return data.ljust(max(1, -(-len(data) // WIDTH)) * WIDTH, b"\xff")


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each whole text as a GIF: ``(id, n_bytes, media)``.

    A null text counts as empty; empty texts give one row of 255s; repeated rows stay repeated; other
    columns are not looked at, whatever their names; an empty table gives an empty result.
    """

    def setup():
        def work(ids: list, texts: list) -> list[tuple]:
            raw = [t.encode("utf-8", "surrogatepass") for t in texts]
            return [(i, len(r), store_payload(padded(r))) for i, r in zip(ids, raw, strict=True)]

        return work

    kind = df.schema[id_col].dataType.simpleString()
    source = df.select(F.col(id_col), text_or_empty(text_col).alias("__text"))
    return map_rows(source, setup, schema_of(f"`{id_col}` {kind}, n_bytes bigint, media binary"))


def frames(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row a frame: id, frame_no, start_ms, delay_ms, width, height, rgba, histogram (24 counts).

    A null or broken GIF gives no rows, nor does one with a canvas or frame of over ``MOST_PIXELS`` pixels; a stream that
    breaks off gives the frames it has. Frames of repeated rows repeat; an empty table gives an empty result; other
    columns aren't looked at.
    """

    def setup():
        def work(ids: list, media: list) -> list[tuple]:
            rows = []
            for i, m in zip(ids, media, strict=True):
                own: list[tuple] = []
                try:
                    for n, f in enumerate(shots(bytes(m)) if m is not None else ()):
                        own.append((i, n, f.start_ms, f.delay_ms, f.rgba.shape[1], f.rgba.shape[0], f.rgba.tobytes(), histogram(f.rgba)))
                except (ValueError, struct.error, IndexError):
                    own = []
                rows += own
            return rows

        return work

    kind = df.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {kind}, frame_no int, start_ms bigint, delay_ms bigint, width int, height int, rgba binary, histogram array<bigint>"
    return map_rows(df.select(id_col, media_col), setup, schema_of(out), chunk_bytes=1 << 20)


def read_texts(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Decode stored media: digests, the timed frames with their colour histograms, and the feature.

    ``frames`` has a struct (start_ms, delay_ms, histogram of the frame's box) a frame; the feature is frame count, duration and
    the grey histogram. ``stored`` is what ``store_texts`` gives; repeated rows repeat and an empty table gives an
    empty result. Media that is no GIF is an error, as a text would be lost.
    """

    def setup():
        def work(ids: list, sizes: list, media: list) -> list[tuple]:
            rows = []
            for i, n, m in zip(ids, sizes, media, strict=True):
                m = bytes(m)
                parts, timed = [], []
                for f in shots(m):
                    x, y, w, h = f.box
                    box = f.rgba[y : y + h, x : x + w]
                    parts.append(box[:, :, 0].tobytes())
                    timed.append((f.start_ms, f.delay_ms, histogram(box)))
                payload = b"".join(parts)
                counts = np.sum([t[2][:HIST_BINS] for t in timed], axis=0)
                feature = f"{len(timed)}f{sum(t[1] for t in timed)}ms:" + ".".join(map(str, counts.tolist()))
                told = [dict(zip(("start_ms", "delay_ms", "histogram"), t, strict=True)) for t in timed]
                rows.append((i, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature, told))
            return rows

        return work

    kind = stored.schema[id_col].dataType.simpleString()
    out = f"`{id_col}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, frames array<struct<start_ms: bigint, delay_ms: bigint, histogram: array<bigint>>>"
    return map_rows(stored.select(id_col, "n_bytes", "media"), setup, schema_of(out))
