"""GIF media columns: decoding into timed frames with colour histograms, and an encoder for tests and for making a media column.

decode() reads GIF87a/89a: the logical screen, global and local palettes, graphic control extensions (delay, transparency, disposal), interlaced
images and LZW streams of variable code size with clear and end codes. Frames are composed on the screen: transparent pixels keep
what is below; after a frame its disposal keeps it (0, 1), clears its rectangle (2), or restores what was before it (3).
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 64
SCHEMA = "id bigint, frame int, start_ms bigint, delay_ms int, width int, height int, opaque int, hist array<int>, rgba binary, error string"


class BadGif(ValueError):
    """The bytes aren't a GIF that can be read. frames: those decoded before that showed."""

    frames: list[Frame] = []


@dataclass
class Frame:
    start_ms: int
    delay_ms: int
    rgba: np.ndarray  # [height, width, 4], the whole screen


def lzw_decode(data: bytes, least: int, count: int) -> np.ndarray:
    """`count` palette indices from an LZW stream with codes of least + 1 bits and more. A stream that ends early leaves zeros."""
    if not 1 <= least <= 11:
        raise BadGif("code size")
    clear, end = 1 << least, (1 << least) + 1
    out = bytearray()
    table: list[bytes] = [bytes([min(i, 255)]) for i in range(clear)] + [b"", b""]
    size, before, bits, have = least + 1, None, 0, 0
    for byte in data:
        bits |= byte << have
        have += 8
        while have >= size:
            code = bits & ((1 << size) - 1)
            bits >>= size
            have -= size
            if code == clear:
                del table[end + 1 :]
                size, before = least + 1, None
                continue
            if code == end:
                return _indices(out, count)
            if before is None:
                if code >= clear:
                    raise BadGif("a code before any literal")
                entry = table[code]
            else:
                if code < len(table):
                    entry = table[code]
                elif code == len(table):
                    entry = before + before[:1]
                else:
                    raise BadGif("a code that isn't in the table")
                if len(table) < 4096:
                    table.append(before + entry[:1])
                    if len(table) == 1 << size and size < 12:
                        size += 1
            out += entry
            before = entry
            if len(out) >= count:
                return _indices(out, count)
    return _indices(out, count)


def _indices(out: bytearray, count: int) -> np.ndarray:
    got = np.zeros(count, np.uint8)
    n = min(count, len(out))
    got[:n] = np.frombuffer(bytes(out[:n]), np.uint8)
    return got


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while True:
        if at >= len(data):
            raise BadGif("it ends within a block")
        n = data[at]
        if not n:
            return b"".join(parts), at + 1
        if at + 1 + n > len(data):
            raise BadGif("it ends within a block")
        parts.append(data[at + 1 : at + 1 + n])
        at += n + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    n = 2 << (flags & 7)
    if at + 3 * n > len(data):
        raise BadGif("it ends within a palette")
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def interlaced_rows(height: int) -> list[int]:
    """The rows of the screen in the order in which an interlaced image stores them."""
    return [r for start, step in ((0, 8), (4, 8), (2, 4), (1, 2)) for r in range(start, height, step)]


def decode(data: bytes, most_pixels: int = 1 << 26) -> list[Frame]:
    """The frames of a GIF, composed. Raises BadGif, with the frames up to there, for bytes that aren't one or are cut off or broken."""
    frames: list[Frame] = []
    try:
        _decode(data, most_pixels, frames)
    except BadGif as e:
        e.frames = frames
        raise
    return frames


def _decode(data: bytes, most_pixels: int, frames: list[Frame]) -> None:
    if len(data) < 13 or data[:6] not in (b"GIF87a", b"GIF89a"):
        raise BadGif("no GIF header")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    if not width or not height or width * height > most_pixels:
        raise BadGif("screen size")
    at, common = 13, None
    if flags & 0x80:
        common, at = _palette(data, at, flags)
    screen = np.zeros((height, width, 4), np.uint8)
    delay, clear_index, disposal, clock = 0, None, 0, 0
    while True:
        if at >= len(data):
            raise BadGif("no trailer")
        kind = data[at]
        at += 1
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at] if at < len(data) else 0
            body, at = _blocks(data, at + 1)
            if label == 0xF9 and len(body) >= 4:
                packed, hundredths, index = struct.unpack_from("<BHB", body)
                delay, disposal, clear_index = hundredths * 10, packed >> 2 & 7, index if packed & 1 else None
            continue
        if kind != 0x2C or at + 9 > len(data):
            raise BadGif("an unknown block")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", data, at)
        at += 9
        palette = common
        if packed & 0x80:
            palette, at = _palette(data, at, packed)
        if palette is None:
            raise BadGif("no palette")
        if at >= len(data):
            raise BadGif("no image data")
        if w * h > most_pixels:
            raise BadGif("image size")
        least = data[at]
        stream, at = _blocks(data, at + 1)
        pixels = lzw_decode(stream, least, w * h).reshape(h, w)
        if packed & 0x40:
            straight = np.empty_like(pixels)
            straight[interlaced_rows(h)] = pixels
            pixels = straight
        before = screen.copy() if disposal == 3 else None
        y, x = slice(top, min(top + h, height)), slice(left, min(left + w, width))
        part = pixels[: max(0, y.stop - top), : max(0, x.stop - left)]
        shown = part < len(palette)
        if clear_index is not None:
            shown &= part != clear_index
        colours = np.full((*part.shape, 4), 255, np.uint8)
        colours[..., :3] = palette[np.minimum(part, len(palette) - 1)]
        area = screen[y, x]
        area[shown] = colours[shown]
        frames.append(Frame(clock, delay, screen.copy()))
        clock += delay
        if disposal == 2:
            screen[y, x] = 0
        elif before is not None:
            screen = before
        delay, clear_index, disposal = 0, None, 0


def histogram(rgba: np.ndarray) -> np.ndarray:
    """Opaque pixels by colour, two bits a channel: bin = 16 * (r >> 6) + 4 * (g >> 6) + (b >> 6)."""
    seen = rgba[rgba[..., 3] > 0].astype(np.int64) >> 6
    return np.bincount(16 * seen[:, 0] + 4 * seen[:, 1] + seen[:, 2], minlength=BINS)


def lzw_encode(indices: bytes, least: int) -> bytes:
    """The LZW stream of palette indices, with a clear code first and whenever the table is full."""
    clear, end = 1 << least, (1 << least) + 1
    out, bits, have = bytearray(), 0, 0
    size, table, following = least + 1, {bytes([i]): i for i in range(clear)}, end + 1

    def put(code: int) -> None:
        nonlocal bits, have
        bits |= code << have
        have += size
        while have >= 8:
            out.append(bits & 255)
            bits >>= 8
            have -= 8

    put(clear)
    run = b""
    for i in indices:
        longer = run + bytes([i])
        if longer in table:
            run = longer
            continue
        put(table[run])
        if following < 4096:
            table[longer] = following
            if following == 1 << size and size < 12:
                size += 1
            following += 1
        else:
            put(clear)
            size, table, following = least + 1, {bytes([k]): k for k in range(clear)}, end + 1
        run = bytes([i])
    if run:
        put(table[run])
        if following == 1 << size and size < 12:  # the decoder has one entry more by now
            size += 1
    put(end)
    if have:
        out.append(bits & 255)
    return bytes(out)


@dataclass
class Image:
    """What encode() writes as a frame: palette indices [h, w] at (left, top)."""

    indices: np.ndarray
    left: int = 0
    top: int = 0
    delay_ms: int = 0
    disposal: int = 0
    clear_index: int | None = None
    interlaced: bool = False
    palette: np.ndarray | None = None


def encode(width: int, height: int, palette: np.ndarray, images: list[Image]) -> bytes:
    """A GIF89a. Palettes are [2**k, 3]."""
    bits = max(1, int(len(palette) - 1).bit_length())
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0x80 | (bits - 1), 0, 0), palette.astype(np.uint8).tobytes()]
    for im in images:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", im.disposal << 2 | (im.clear_index is not None), im.delay_ms // 10, im.clear_index or 0) + b"\x00")
        h, w = im.indices.shape
        own = im.palette is not None
        size = max(1, int(len(im.palette if own else palette) - 1).bit_length())
        out.append(b"\x2c" + struct.pack("<HHHHB", im.left, im.top, w, h, (0x80 | (size - 1) if own else 0) | (0x40 if im.interlaced else 0)))
        if own:
            out.append(im.palette.astype(np.uint8).tobytes())
        rows = im.indices[interlaced_rows(h)] if im.interlaced else im.indices
        least = max(2, size)
        stream = lzw_encode(rows.astype(np.uint8).tobytes(), least)
        out.append(bytes([least]) + b"".join(bytes([len(stream[i : i + 255])]) + stream[i : i + 255] for i in range(0, len(stream), 255)) + b"\x00")
    return b"".join([*out, b"\x3b"])


def frames(media: DataFrame) -> DataFrame:
    """media: (id, gif). A row for each frame: id, frame number from 0, start and delay in ms, screen size, opaque pixels, colour histogram, RGBA pixels.

    Null media have no rows. Bytes that can't be read, empty ones included, and GIFs whose screen or an image has more than 2**26
    pixels have one row with frame null and the reason in error, after the rows of the frames before the fault. A null id stays null;
    repeated rows give their frames each. A GIF without images has no rows. Other columns are ignored. An empty table: empty result.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, gif in zip(batch.column("id").to_pylist(), batch.column("gif").to_pylist()):
                if gif is not None:
                    error = None
                    try:
                        found = decode(gif)
                    except BadGif as e:
                        found, error = e.frames, str(e)
                    rows = [(i, k, f.start_ms, f.delay_ms, f.rgba.shape[1], f.rgba.shape[0], int((f.rgba[..., 3] > 0).sum()), histogram(f.rgba).tolist(), f.rgba.tobytes(), None) for k, f in enumerate(found)]
                    if error is not None:
                        rows.append((i, None, None, None, None, None, None, None, None, error))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], names=_NAMES)

    return media.select(F.col("id").cast("bigint"), F.col("gif").cast("binary")).mapInArrow(work, SCHEMA)


_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
_TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.string()]

#: The colours of the media column made from vectors: 16, all in different histogram bins but for two pairs or so.
PALETTE = np.array([[17 * c, 17 * (15 - c), 17 * (5 * c % 16)] for c in range(16)], np.uint8)
SIDE = 8


def levels(vector: np.ndarray) -> np.ndarray:
    """Values from -0.6 to 0.6 as palette indices 0..15."""
    return np.clip(np.floor((vector.astype(np.float64) + 0.6) / 1.2 * 16), 0, 15).astype(np.uint8)


def vector_media(vectors: DataFrame) -> DataFrame:
    """(id, gif) of each row (vec_id, embedding) with 64 values: an animation of the vector as 8 x 8 pixels.

    First all pixels; then rows 2-5 of columns 2-5 with colour 15 - c, colour 0 transparent, cleared afterwards; then the upper half interlaced, with
    index 15 - c again. So a decoder has to get palettes, transparency, disposal and interlacing right. Vectors that are null, have a
    null in them or another length have a null gif.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for v in batch.column("v").to_pylist():
                if v is None or len(v) != SIDE * SIDE or any(x is None or x != x for x in v):
                    out.append(None)
                    continue
                q = levels(np.array(v, np.float32)).reshape(SIDE, SIDE)
                other = 15 - q
                out.append(encode(SIDE, SIDE, PALETTE, [Image(q, delay_ms=100, disposal=1), Image(other[2:6, 2:6], 2, 2, 50, 2, 0), Image(other[:4], 0, 0, 200, 1, interlaced=True)]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary())], names=["id", "gif"])

    return vectors.select(F.col("vec_id").cast("bigint").alias("id"), F.col("embedding").cast("array<float>").alias("v")).mapInArrow(work, "id bigint, gif binary")
