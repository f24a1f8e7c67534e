"""TIFF images as media columns: a decoder that emits one row per page, an encoder, and features of stored samples.

The decoder walks the chain of image directories of either byte order, reads strips or tiles, decodes none, PackBits, LZW
or deflate, undoes horizontal differencing, and gives 8-bit samples. A page that is damaged or of another kind gives a
row with ``error`` set and no samples; later pages are still read. Null media give no rows; bytes that are no TIFF give
one row with an error. Nothing larger than ``MOST`` samples is decoded, whatever a directory claims.
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

from . import common

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
#: Most samples of a page, most pages of a file.
MOST, PAGES = 1 << 30, 1 << 16
#: Tags that are read (fixed values of the format).
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS, COUNTS = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_COUNTS = 284, 317, 322, 323, 324, 325
_TYPES = {1: "B", 3: "H", 4: "I"}


# --- codecs -----------------------------------------------------------------------------------------------------------


def unpack_packbits(raw: bytes) -> bytes:
    """PackBits: a header n < 128 copies n + 1 bytes, one over 128 repeats a byte 257 - n times."""
    out, i, n = bytearray(), 0, len(raw)
    while i < n:
        h = raw[i]
        if h < 128:
            out += raw[i + 1 : i + 2 + h]
            i += h + 2
        else:
            if h > 128:
                out += raw[i + 1 : i + 2] * (257 - h)
            i += 2 if h > 128 else 1
    return bytes(out)


def pack_packbits(raw: bytes) -> bytes:
    """Runs of 3 or more bytes as repeats, the rest as copies."""
    x = np.frombuffer(raw, np.uint8)
    if not len(x):
        return b""
    cut = np.flatnonzero(np.diff(x)) + 1
    starts, ends = np.append(0, cut), np.append(cut, len(x))
    long = ends - starts >= 3
    out, last = bytearray(), 0

    def literal(a: int, b: int) -> None:
        for s in range(a, b, 128):
            part = raw[s : min(s + 128, b)]
            out.append(len(part) - 1)
            out.extend(part)

    for s, e in zip(starts[long].tolist(), ends[long].tolist()):
        literal(last, s)
        while s < e:
            k = min(128, e - s)
            out.append(257 - k) if k > 1 else out.append(0)
            out.append(raw[s])
            s += k
        last = e
    literal(last, len(x))
    return bytes(out)


def unpack_lzw(raw: bytes) -> bytes:
    """TIFF's LZW: codes most significant bit first, 9 to 12 bits, widened one code early; 256 clears, 257 ends."""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out = list(base), []
    held, bits, width, last = 0, 0, 9, None
    for byte in raw:
        held = (held << 8 | byte) & 0xFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(base), 9, None
            continue
        if last is None:
            entry = table[code]
        else:
            if code > len(table):
                raise ValueError("LZW code ahead of its table")
            entry = table[code] if code < len(table) else last + last[:1]
            table.append(last + entry[:1])
        out.append(entry)
        last = entry
        width = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def pack_lzw(raw: bytes) -> bytes:
    """The inverse of unpack_lzw."""
    held, bits, out = 0, 0, bytearray()
    table: dict[bytes, int] = {}
    width, last, size = 9, b"", 258

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    of = lambda s: s[0] if len(s) == 1 else table[s]
    put(256)
    for k in range(len(raw)):
        b = raw[k : k + 1]
        if len(last) == 0 or last + b in table:
            last += b
            continue
        put(of(last))
        table[last + b] = size
        size += 1
        last = b
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        if size >= 4094:
            put(256)
            table, size, width = {}, 258, 9
    if last:
        put(of(last))
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def unpack(raw: bytes, compression: int, size: int) -> np.ndarray:
    """The ``size`` samples of a strip or tile."""
    if compression == NONE:
        made = raw
    elif compression == PACKBITS:
        made = unpack_packbits(raw)
    elif compression == LZW:
        made = unpack_lzw(raw)
    elif compression in (DEFLATE, OLD_DEFLATE):
        made = zlib.decompressobj().decompress(raw, size)
    else:
        raise ValueError(f"compression {compression}")
    if len(made) < size:
        raise ValueError("a strip or tile is too short")
    return np.frombuffer(made, np.uint8, size)


def pack(samples: np.ndarray, compression: int, level: int = 1) -> bytes:
    """A strip or tile as bytes."""
    raw = samples.tobytes()
    return {NONE: bytes, PACKBITS: pack_packbits, LZW: pack_lzw, DEFLATE: lambda x: zlib.compress(x, level)}[compression](raw)


# --- files ------------------------------------------------------------------------------------------------------------


def directories(media: bytes) -> Iterator[dict[int, tuple] | str]:
    """The tags of each image directory; a message where the chain breaks."""
    order = {b"II": "<", b"MM": ">"}.get(media[:2])
    if order is None or len(media) < 8 or struct.unpack(order + "H", media[2:4])[0] != 42:
        yield "not a TIFF"
        return
    at, seen = struct.unpack(order + "I", media[4:8])[0], set()
    while at:
        if at in seen or at + 2 > len(media) or len(seen) >= PAGES:
            yield "the chain of directories breaks"
            return
        seen.add(at)
        n = struct.unpack_from(order + "H", media, at)[0]
        if at + 6 + 12 * n > len(media):
            yield "a directory is cut off"
            return
        tags = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", media, at + 2 + 12 * k)
            if kind in _TYPES:
                form = f"{order}{count}{_TYPES[kind]}"
                size = struct.calcsize(_TYPES[kind]) * count
                place = at + 10 + 12 * k if size <= 4 else struct.unpack_from(order + "I", media, at + 10 + 12 * k)[0]
                if place + size <= len(media):
                    tags[tag] = struct.unpack_from(form, media, place)
        yield tags
        at = struct.unpack_from(order + "I", media, at + 2 + 12 * n)[0]


def page_of(media: bytes, tags: dict[int, tuple]) -> np.ndarray:
    """height x width x samples of a page."""
    one = lambda tag, default=None: tags[tag][0] if tag in tags else default
    width, height, deep = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    if not width or not height or not deep or width * height * deep > MOST:
        raise ValueError("a page of no or too large a size")
    if set(tags.get(BITS, (1,))) != {8} or one(PLANAR, 1) != 1:
        raise ValueError("only chunky 8-bit samples are read")
    compression, predictor = one(COMPRESSION, NONE), one(PREDICTOR, 1)
    if predictor not in (1, 2):
        raise ValueError(f"predictor {predictor}")
    tiled = TILE_WIDTH in tags
    w, h = (one(TILE_WIDTH), one(TILE_HEIGHT)) if tiled else (width, min(one(ROWS, height), height))
    offsets, counts = (tags.get(TILE_OFFSETS, ()), tags.get(TILE_COUNTS, ())) if tiled else (tags.get(OFFSETS, ()), tags.get(COUNTS, ()))
    if not w or not h or w * h * deep > MOST:
        raise ValueError("a strip or tile of no or too large a size")
    across, down = -(-width // w), -(-height // h)
    if len(offsets) < across * down or len(counts) < across * down:
        raise ValueError("strips or tiles are missing")
    out = np.empty((height, width, deep), np.uint8)
    for k in range(across * down):
        y, x = k // across * h, k % across * w
        rows = h if tiled else min(h, height - y)
        raw = media[offsets[k] : offsets[k] + counts[k]]
        part = unpack(raw, compression, rows * w * deep).reshape(rows, w, deep)
        if predictor == 2:
            part = np.add.accumulate(part, axis=1, dtype=np.uint8)
        out[y : y + rows, x : x + w] = part[: height - y, : width - x]
    return out


def encode(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows: int = 256, tile: int = 0, order: str = "<") -> bytes:
    """A TIFF of 8-bit pages (height x width x samples), in strips of ``rows`` rows or in square tiles."""
    out = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0))
    link = 4
    for page in pages:
        height, width, deep = page.shape
        w, h = (tile, tile) if tile else (width, min(rows, height))
        offsets, counts = [], []
        for y in range(0, height, h):
            for x in range(0, width, w):
                part = page[y : y + h, x : x + w]
                if tile and part.shape[:2] != (h, w):
                    part = np.pad(part, ((0, h - part.shape[0]), (0, w - part.shape[1]), (0, 0)), mode="edge")
                if predictor == 2:
                    part = np.concatenate([part[:, :1], np.diff(part, axis=1)], axis=1)
                raw = pack(np.ascontiguousarray(part), compression)
                offsets.append(len(out))
                counts.append(len(raw))
                out += raw
        tags = {WIDTH: [width], HEIGHT: [height], BITS: [8] * deep, COMPRESSION: [compression], PHOTOMETRIC: [2 if deep == 3 else 1], SAMPLES: [deep], PLANAR: [1], PREDICTOR: [predictor]}
        tags |= {TILE_WIDTH: [tile], TILE_HEIGHT: [tile], TILE_OFFSETS: offsets, TILE_COUNTS: counts} if tile else {OFFSETS: offsets, ROWS: [h], COUNTS: counts}
        fields = []
        for tag in sorted(tags):
            kind, values = (3 if tag in (BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR) else 4), tags[tag]
            raw = struct.pack(f"{order}{len(values)}{_TYPES[kind]}", *values)
            if len(raw) > 4:
                out += b"\0" * (len(out) % 2)
                raw, at = struct.pack(order + "I", len(out)), raw
                out += at
            fields.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        out += b"\0" * (len(out) % 2)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(fields)) + b"".join(fields)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


# --- columns ----------------------------------------------------------------------------------------------------------

_PAGE = "page int, width int, height int, samples int, compression int, predictor int, pixels binary, error string"
_PAGE_ARROW = pa.schema([("id", pa.int64()), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("compression", pa.int32()), ("predictor", pa.int32()), ("pixels", pa.binary()), ("error", pa.string())])


def page_rows(media: bytes) -> Iterator[tuple]:
    """What each page of a file has, as the columns of ``pages``."""
    for k, tags in enumerate(directories(media)):
        if isinstance(tags, str):
            yield k, None, None, None, None, None, None, tags
            continue
        facts = [tags.get(t, (d,))[0] for t, d in ((WIDTH, None), (HEIGHT, None), (SAMPLES, 1), (COMPRESSION, NONE), (PREDICTOR, 1))]
        facts = [x if x is None or x < 1 << 31 else None for x in facts]
        try:
            yield k, *facts, page_of(media, tags).tobytes(), None
        except (ValueError, zlib.error, IndexError) as e:
            yield k, *facts, None, str(e)


def pages(media: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """(id, page, width, height, samples, compression, predictor, pixels, error): a row per page of every file."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, m in zip(b.column(0).to_pylist(), b.column(1)):
                rows = [(i, *r) for r in page_rows(m.as_py())] if m.is_valid else []
                yield common.batch(_PAGE_ARROW, *([r[c] for r in rows] for c in range(len(_PAGE_ARROW))))

    common.prepare(media.sparkSession)
    return media.select(F.col(id_col).cast("long"), F.col(media_col)).mapInArrow(work, f"id long, {_PAGE}")


#: A page of a stored text is WIDE samples wide and at most TALL rows high; a payload is a multiple of UNIT bytes.
WIDE, TALL, UNIT = 192, 1024, 192


def store_text(text: bytes) -> bytes:
    """A text as a TIFF: padded with spaces to a positive multiple of 192 bytes, 192 grey samples a row."""
    size = max(UNIT, -(-len(text) // UNIT) * UNIT)
    x = np.frombuffer(text.ljust(size), np.uint8).reshape(-1, WIDE, 1)
    return encode([x[s : s + TALL] for s in range(0, len(x), TALL)], DEFLATE, 2)


def feature_of(samples: bytes) -> str:
    """Mean and spread in whole thousandths, and a 64-bit difference hash of an 8 x 9 grid of block means."""
    x = np.frombuffer(samples, np.uint8).reshape(-1, WIDE)
    total, n = int(x.sum(dtype=np.int64)), x.size
    square = int((np.bincount(x.ravel(), minlength=256) * np.arange(256, dtype=np.int64) ** 2).sum())
    high = np.linspace(0, len(x), 9).astype(int)
    wide = np.linspace(0, WIDE, 10).astype(int)
    column = np.add.reduceat(x, wide[:-1], axis=1, dtype=np.int64)
    upto = np.vstack([np.zeros((1, 9), np.int64), np.cumsum(column, 0)])
    grid = upto[np.maximum(high[1:], high[:-1] + 1).clip(max=len(x))] - upto[np.minimum(high[:-1], len(x) - 1)]
    cell = grid * 1000 // np.diff(wide)
    bits = np.packbits((cell[:, 1:] > cell[:, :-1]).ravel()).tobytes().hex()
    return f"mean={total * 1000 // n};var={(square * n - total * total) * 1000 // (n * n)};dhash={bits}"


def stored_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, pages): every whole
    text stored as a TIFF, the rest read back from the stored bytes. Null text is the empty text."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("pages", pa.int32())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), common.text_bytes(b.column(1))):
                media = store_text(t)
                got = list(page_rows(media))
                if any(r[-1] for r in got):
                    raise ValueError(f"a stored page can't be read: {[r[-1] for r in got if r[-1]][0]}")
                payload = b"".join(r[-2] for r in got)
                rows.append((i, len(t), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(payload), len(got)))
            yield common.batch(schema, *([r[c] for r in rows] for c in range(len(schema))))

    common.prepare(docs.sparkSession)
    made = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return made.mapInArrow(work, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int")
