"""GIF columns: encode samples as timed GIF frames, decode LZW code streams, compose frames.

``decode`` reads any GIF87a or GIF89a: code streams, global and local palettes, interlacing,
disposal and transparency rules. LZW is decoded with arrays: code widths depend only on the
number of codes since the last clear code, an entry is the output of one code and the byte after
it, so each output byte points at an earlier one and the pointers are followed by doubling.

``encode`` writes samples with a grey palette of 256 and frames of ``WIDTH`` columns as LZW codes that
grow from 9 to 12 bits, with a clear code when the table is full. Frames take the disposals leave, restore
the picture before and restore the background in turn, and a sample that already stands on the canvas is written
as a transparent entry where the frame leaves a value unused, so the samples come back only from the composed frames.

Defined cases: null and empty texts become one row of blanks; texts of any length are split over
frames of at most ``ROWS`` rows; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm.common import text_of

WIDTH, ROWS, DELAY = 192, 32, 4
#: Disposals of frames in turn: leave, restore the picture before, restore the background.
DISPOSALS = (1, 3, 2)
#: Codes of a table: the last entry of twelve bits is made with this many.
FULL = 4095 - 257
_PALETTE = bytes(v for i in range(256) for v in (i, i, i))
#: Width of the code that follows so many codes since the last clear code.
_WIDTHS = np.array([max(9, (257 + j).bit_length()) for j in range(FULL + 1)], np.int64)


def lzw_encode(data: bytes) -> bytes:
    """LZW code stream of 8-bit samples: the longest known string each time, table cleared when full."""
    codes, book, made, since = [256], {}, 258, [0]
    put, mark, start = codes.append, since.append, 1
    current = -1
    for sample in data:
        if current < 0:
            current = sample
            continue
        key = current << 8 | sample
        if key in book:
            current = book[key]
            continue
        put(current)
        current = sample
        if made == 4095:
            put(256)
            mark(len(codes) - 1)
            book, made = {}, 258
        else:
            book[key] = made
            made += 1
    put(current)
    put(257)
    # widths from the number of codes since the clear code before; a first clear code has nine bits
    n = np.array(codes, np.uint32)
    age = np.arange(len(n)) - np.repeat(np.array(since), np.diff([*since, len(n)])) - 1
    for at in since[1:]:
        age[at] = FULL
    width = _WIDTHS[np.maximum(age, 0)]
    end = np.cumsum(width)
    bit = end - width
    out = np.zeros((int(end[-1]) + 7) // 8 + 3, np.uint32)
    shifted = n << (bit & 7).astype(np.uint32)
    for k in range(3):
        np.add.at(out, (bit >> 3) + k, (shifted >> np.uint32(8 * k)) & np.uint32(255))
    return out[: (int(end[-1]) + 7) // 8].astype(np.uint8).tobytes()


def _blocks(data: bytes) -> bytes:
    """Sub-blocks of at most 255 bytes and the end."""
    n = len(data) // 255
    head = np.empty((n, 256), np.uint8)
    head[:, 0] = 255
    head[:, 1:] = np.frombuffer(data, np.uint8, n * 255).reshape(n, 255)
    rest = data[n * 255 :]
    return head.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


def encode(samples: bytes, rows: int = ROWS) -> bytes:
    """A GIF whose composed frames hold the samples, a positive multiple of WIDTH of them, in order."""
    height = len(samples) // WIDTH
    out = [b"GIF89a" + struct.pack("<HHBBB", WIDTH, min(height, rows), 0xF7, 0, 0) + _PALETTE]
    # what stands on the canvas, -1: nothing
    canvas = np.full(min(height, rows) * WIDTH, -1, np.int16)
    for k, top in enumerate(range(0, height, rows)):
        part = np.frombuffer(samples, np.uint8)[top * WIDTH : (top + rows) * WIDTH]
        n, disposal = len(part), DISPOSALS[k % len(DISPOSALS)]
        stands = canvas[:n] == part
        unused = int(np.bincount(part, minlength=256).argmin())
        clear = unused if stands.any() and not (part == unused).any() else None
        shown = part if clear is None else np.where(stands, np.uint8(clear), part)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHB", disposal << 2 | (clear is not None), DELAY, clear or 0) + b"\0")
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, WIDTH, n // WIDTH, 0) + b"\x08" + _blocks(lzw_encode(shown.tobytes())))
        if disposal == 1:
            canvas[:n] = part
        elif disposal == 2:
            canvas[:n] = -1
    return b"".join(out) + b"\x3b"


def _codes(data: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of a stream up to its end code, and of each the number of codes since the last clear code (0: a clear code).

    Widths are fixed between clear codes, so codes are read in blocks and a block is used up to its first clear code."""
    clear, end = 1 << least, (1 << least) + 1
    buf = np.concatenate([data, np.zeros(8, np.uint8)])
    total = len(data) * 8
    bit, since, codes, ages = 0, 0, [], []
    while bit < total:
        # codes of one width: entry number clear + 2 + since - 1 is made when code `since` + 1 is read
        made = clear + 2 + max(0, since - 1)
        width = min(12, max(least + 1, int(made).bit_length()))
        count = min((total - bit) // width, (1 << 30) if width == 12 else (1 << width) - made if since else 1)
        if since == 0:
            # a literal right after a clear code makes no entry: two codes before the table grows by one
            count = min((total - bit) // width, (1 << width) - made + 1)
        if count <= 0:
            break
        count = min(count, 1 << 14)
        at = bit + np.arange(count, dtype=np.int64) * width
        byte = at >> 3
        got = (buf[byte].astype(np.uint32) | (buf[byte + 1].astype(np.uint32) << 8) | (buf[byte + 2].astype(np.uint32) << 16)) >> (at & 7).astype(np.uint32)
        got &= (1 << width) - 1
        stop = np.flatnonzero((got == clear) | (got == end))
        if len(stop):
            k = int(stop[0])
            codes.append(got[:k])
            ages.append(since + 1 + np.arange(k))
            bit += (k + 1) * width
            if got[k] == end:
                break
            since = 0
        else:
            codes.append(got)
            ages.append(since + 1 + np.arange(count))
            bit += count * width
            since += count
    if not codes:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    return np.concatenate(codes), np.concatenate(ages)


def lzw_decode(data: bytes | np.ndarray, least: int, n: int) -> np.ndarray:
    """At most n samples of an LZW code stream with codes of least + 1 bits at first."""
    data = np.frombuffer(data, np.uint8) if isinstance(data, bytes) else data
    codes, ages = _codes(data, least)
    m = len(codes)
    if not m:
        return np.zeros(0, np.uint8)
    codes = codes.astype(np.int64)
    base = np.arange(m) - (ages - 1)  # first code after the clear code
    entry = codes - ((1 << least) + 2)  # entry e holds the output of code base + e and one byte more
    literal = codes < (1 << least)
    source = np.where(literal, -1, base + entry)
    if ((source >= np.arange(m)) & ~literal).any() or (~literal & (entry < 0)).any():
        raise ValueError("a code that no entry has")
    # lengths: 1 for literals, else 1 + length of the source, by pointer doubling
    length, jump = np.ones(m, np.int64), source.copy()
    while (jump >= 0).any():
        live = jump >= 0
        length[live] += length[jump[live]]
        jump[live] = jump[jump[live]]
    ends = np.cumsum(length)
    starts = ends - length
    total = int(ends[-1])
    owner = np.repeat(np.arange(m), length)
    lit = literal[owner]
    # byte k of a code's output is byte k from the start of its source's output; the last one lies just behind it
    point = np.where(lit, np.arange(total), starts[np.maximum(source, 0)][owner] + np.arange(total) - starts[owner])
    while True:
        further = point[point]
        if (further == point).all():
            break
        point = further
    return codes[owner[point]].astype(np.uint8)[:n]


def decode(gif: bytes) -> tuple[int, int, list[dict]]:
    """Width, height and frames: delay, box (left, top, width, height), disposal, indices, and the composed canvas (height, width, 4) as RGBA."""
    if gif[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", gif, 6)
    at, table = 13, None
    if flags & 0x80:
        size = 3 << ((flags & 7) + 1)
        table, at = np.frombuffer(gif, np.uint8, size, at).reshape(-1, 3), at + size
    canvas = np.zeros((height, width, 4), np.uint8)
    frames, control = [], (0, 0, None)

    def sub_blocks(at: int) -> tuple[np.ndarray, int]:
        begin = at
        while gif[at]:
            at += gif[at] + 1
        raw = np.frombuffer(gif, np.uint8, at - begin, begin)
        full = (at - begin) // 256
        if full and (raw[: full * 256 : 256] == 255).all():
            rest = raw[full * 256 :]
            data = [raw[: full * 256].reshape(-1, 256)[:, 1:].ravel(), rest[1:]]
            if not len(rest) or rest[0] == len(rest) - 1:
                return np.concatenate(data), at + 1
        parts, k = [], begin
        while gif[k]:
            parts.append(np.frombuffer(gif, np.uint8, gif[k], k + 1))
            k += gif[k] + 1
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint8)), at + 1

    while at < len(gif) and gif[at] != 0x3B:
        if gif[at] == 0x21:
            if gif[at + 1] == 0xF9:
                packed, delay, clear = struct.unpack_from("<BHB", gif, at + 3)
                control = ((packed >> 2) & 7, delay, clear if packed & 1 else None)
            _, at = sub_blocks(at + 2)
            continue
        if gif[at] != 0x2C:
            raise ValueError("an unknown block")
        left, top, w, h, packed = struct.unpack_from("<HHHHB", gif, at + 1)
        at, palette = at + 10, table
        if packed & 0x80:
            size = 3 << ((packed & 7) + 1)
            palette, at = np.frombuffer(gif, np.uint8, size, at).reshape(-1, 3), at + size
        least = gif[at]
        data, at = sub_blocks(at + 1)
        pixels = lzw_decode(data, least, w * h)
        if len(pixels) < w * h:
            raise ValueError("a frame lacks samples")
        pixels = pixels.reshape(h, w)
        if packed & 0x40:
            order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            straight = np.empty_like(pixels)
            straight[order] = pixels
            pixels = straight
        disposal, delay, clear = control
        before = canvas.copy() if disposal == 3 else None
        box = canvas[top : top + h, left : left + w]
        shown = pixels[: box.shape[0], : box.shape[1]]
        full = np.full((256, 4), 255, np.uint8)
        full[: len(palette), :3] = palette
        colour = full[shown]
        if clear is None:
            box[:] = colour
        else:
            seen = shown != clear
            box[seen] = colour[seen]
        frames.append({"delay": delay, "box": (left, top, w, h), "disposal": disposal, "indices": pixels, "canvas": canvas.copy()})
        if disposal == 2:
            box[:] = 0
        elif disposal == 3:
            canvas = before
        control = (0, 0, None)
    return width, height, frames


def histogram(frame: dict) -> np.ndarray:
    """Counts of a frame's composed colours in 4 levels of red, green and blue; transparent pixels don't count."""
    x = frame["canvas"].reshape(-1, 4)
    x = x[x[:, 3] > 0] >> 6
    return np.bincount(x[:, 0].astype(np.int64) * 16 + x[:, 1] * 4 + x[:, 2], minlength=64)


def texts_to_gif(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, media: the text's bytes, padded with blanks to a positive multiple of WIDTH, as a GIF."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            # few rows at a time, so that long texts do not meet in one buffer
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                raw = [x.as_buffer().to_pybytes() for x in part.column(1)]
                media = [encode(x + b" " * (WIDTH - len(x) if not x else -len(x) % WIDTH)) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    kind = dict(docs.dtypes)[id_col]
    slim = docs.select(F.col(id_col).alias("id"), text_of(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(run, f"id {kind}, n_bytes long, media binary").withColumnRenamed("id", id_col)


def gif_features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """The rows of media with what their decoded frames hold: payload columns, frames, duration_cs, and the colour histogram of all frames."""
    kind = dict(media.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                rows = []
                for x in part.column(2):
                    gif = x.as_buffer().to_pybytes()
                    w, h, frames = decode(gif)
                    # grey levels of what each frame shows in its box once it is composed
                    payload = b"".join(f["canvas"][: f["box"][3], :, 0].tobytes() for f in frames)
                    colours = sum((histogram({"canvas": f["canvas"][: f["box"][3]]}) for f in frames), np.zeros(64, np.int64))
                    delays = [f["delay"] for f in frames]
                    feature = f"{w}x{h};{len(frames)};{sum(delays)};" + ",".join(f"{k}:{n}" for k, n in enumerate(colours.tolist()) if n)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(gif), hashlib.sha256(gif).hexdigest(), feature, len(frames), sum(delays), delays, colours.tolist()))
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
                names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "duration_cs", "delays_cs", "colour_histogram"]
                columns = zip(*rows, strict=True) if rows else [[]] * len(types)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(list(c), t) for c, t in zip(columns, types, strict=True))], ["id", "n_bytes", *names])

    schema = f"id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_frames int, duration_cs long, delays_cs array<int>, colour_histogram array<long>"
    return media.select(F.col(id_col).alias("id"), "n_bytes", F.col(media_col).alias("media")).mapInArrow(run, schema).withColumnRenamed("id", id_col)
