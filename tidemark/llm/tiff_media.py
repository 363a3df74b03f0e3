"""Media columns: whole TIFF files in a binary column, read page by page.

The reader walks the chain of image directories, gathers strips or tiles, decodes PackBits, LZW or
deflate, undoes horizontal predictors and yields one page after the other; `pages` gives one row per
page. 8-bit (and 16-bit, for the predictor) samples, chunky or planar, either byte order.
The writer stores 8-bit grayscale pages in strips or tiles with any of these compressions.

Defined cases: a null file gives no page. A page that cannot be decoded (another compression, bytes that end
early, sizes that are zero or need more than `max_page` bytes) gives a row with its number and the reason in `error`, and the
pages after it are still read; a file that is not a TIFF, or whose chain of directories breaks off, gives such a row with page -1
after the pages before. Repeated rows stay repeated. Columns in keep that are named like a new one are left out.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, bounded

# TIFF 6.0 tags, field sizes and compression numbers.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_BYTES = 284, 317, 322, 323, 324, 325
FIELD = {1: "B", 2: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946
CLEAR, END = 256, 257


SURPLUS = "a strip or tile holds more than its page has room for"


def unpack_bits(data: bytes, most: int = 1 << 30) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        if len(out) > most:
            break
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += head + 2
        elif head > 128:
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    if len(out) > most:
        raise ValueError(SURPLUS)
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three and more are repeated, all else is literal."""
    a = np.frombuffer(data, np.uint8)
    if not len(a):
        return b""
    starts = np.flatnonzero(np.r_[True, a[1:] != a[:-1]])
    out, literal = bytearray(), bytearray()

    def flush():
        for at in range(0, len(literal), 128):
            piece = literal[at : at + 128]
            out.append(len(piece) - 1)
            out.extend(piece)
        literal.clear()

    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(a)], strict=True):
        if e - s < 3:
            literal += data[s:e]
            continue
        flush()
        for at in range(s, e, 128):
            n = min(128, e - at)
            out += bytes([257 - n, data[s]]) if n > 1 else bytes([0, data[s]])
    flush()
    return bytes(out)


def lzw_decode(data: bytes, most: int = 1 << 30) -> bytes:
    """MSB-first codes of 9 to 12 bits; widths grow one code early, as TIFF has it. More than `most` bytes raise."""
    size = 0
    table: list[bytes] = []
    out, bits, held, width, last = [], 0, 0, 9, b""
    for byte in data:
        bits = (bits << 8) | byte
        held += 8
        if held < width:
            continue
        held -= width
        code = bits >> held
        bits &= (1 << held) - 1
        if code == CLEAR:
            table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
            continue
        if code == END:
            break
        if not table or code > len(table) or (code == len(table) and not last):
            raise ValueError("LZW code out of range")
        entry = table[code] if code < len(table) else last + last[:1]
        out.append(entry)
        size += len(entry)
        if size > most:
            raise ValueError(SURPLUS)
        if last:
            table.append(last + entry[:1])
        last = entry
        width = 9 + (len(table) >= 511) + (len(table) >= 1023) + (len(table) >= 2047)
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    acc, held, out = 0, 0, bytearray()

    def put(code: int, width: int):
        nonlocal acc, held
        acc, held = (acc << width) | code, held + width
        while held >= 8:
            held -= 8
            out.append(acc >> held)
            acc &= (1 << held) - 1

    table, n, width, run = {bytes([i]): i for i in range(256)}, 258, 9, b""
    put(CLEAR, 9)
    for i in range(len(data)):
        c = data[i : i + 1]
        if run + c in table:
            run += c
            continue
        put(table[run], width)
        table[run + c] = n
        n += 1
        width = 9 + (n >= 512) + (n >= 1024) + (n >= 2048)
        if n >= 4094:
            put(CLEAR, width)
            table, n, width = {bytes([i]): i for i in range(256)}, 258, 9
        run = c
    if run:
        put(table[run], width)
        n += 1
        width = 9 + (n >= 512) + (n >= 1024) + (n >= 2048)
    put(END, width)
    if held:
        out.append((acc << (8 - held)) & 255)
    return bytes(out)


def inflate(data: bytes, most: int) -> bytes:
    stream = zlib.decompressobj()
    out = stream.decompress(data, most + 1)
    if len(out) > most:
        raise ValueError(SURPLUS)
    if not stream.eof:
        raise ValueError("a deflated strip or tile ends early")
    return out


def plain(data: bytes, most: int) -> bytes:
    if len(data) > most:
        raise ValueError(SURPLUS)
    return data


DECODE = {NONE: plain, LZW: lzw_decode, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: unpack_bits}
ENCODE = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: pack_bits}


@dataclass
class Page:
    index: int
    width: int
    height: int
    channels: int
    bits: int
    compression: int
    tiled: bool
    samples: bytes  # row by row, channels interleaved, most significant byte first for 16 bits


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list[int]]]]:
    """The byte order and fields of each image directory, in the order of the chain."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(bytes(data[:4]))
    if order is None:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen = set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        fields = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * i)
            if kind in FIELD:
                wide = struct.calcsize(FIELD[kind]) * count
                place = at + 10 + 12 * i if wide <= 4 else struct.unpack_from(order + "I", data, at + 10 + 12 * i)[0]
                if wide > len(data):
                    raise ValueError("a field is longer than the file")
                fields[tag] = list(struct.unpack_from(f"{order}{count}{FIELD[kind]}", data, place))
        yield order, fields
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


BROKEN = (ValueError, KeyError, IndexError, ZeroDivisionError, OverflowError, MemoryError, TypeError, struct.error, zlib.error)  # what bad bytes raise


def read_pages(data: bytes) -> Iterator[Page]:
    for index, (order, f) in enumerate(directories(data)):
        yield read_page(data, index, order, f)


def read_page(data: bytes, index: int, order: str, f: dict[int, list[int]], max_page: int = 1 << 28) -> Page:
    width, height, channels = f[WIDTH][0], f[HEIGHT][0], f.get(SAMPLES, [1])[0]
    bits, kind, predictor = f.get(BITS, [8])[0], f.get(COMPRESSION, [NONE])[0], f.get(PREDICTOR, [1])[0]
    if kind not in DECODE or bits not in (8, 16) or predictor not in (1, 2):
        raise ValueError(f"compression {kind}, {bits} bits or predictor {predictor} is not supported")
    if min(width, height, channels) < 1 or width * height * channels * bits // 8 > max_page:
        raise ValueError(f"a page of {width} x {height} x {channels} samples is empty or too large")
    tiled = TILE_OFFSETS in f
    tw, th = (f[TILE_WIDTH][0], f[TILE_HEIGHT][0]) if tiled else (width, min(height, f.get(ROWS_PER_STRIP, [height])[0]))
    if min(tw, th) < 1 or tw * th * channels * bits // 8 > max_page:
        raise ValueError(f"strips or tiles of {tw} x {th} are empty or too large")
    offsets, sizes = f[TILE_OFFSETS if tiled else STRIP_OFFSETS], f[TILE_BYTES if tiled else STRIP_BYTES]
    planes = channels if f.get(PLANAR, [1])[0] == 2 else 1
    per = channels // planes
    across, down = -(-width // tw), -(-height // th)
    dtype = np.dtype(np.uint8) if bits == 8 else np.dtype(order + "u2")
    image = np.zeros((height, width, channels), dtype.newbyteorder(">") if bits == 16 else dtype)
    if len(offsets) < across * down * planes:
        raise ValueError("strips or tiles are missing")
    for i, (offset, size) in enumerate(zip(offsets, sizes, strict=True)):
        plane, cell = divmod(i, across * down)
        if plane >= planes:
            raise ValueError("more strips or tiles than the page has room for")
        y, x = cell // across * th, cell % across * tw
        rows = th if tiled else min(th, height - y)
        if offset + size > len(data):
            raise ValueError("a strip or tile lies beyond the end")
        raw = DECODE[kind](data[offset : offset + size], rows * tw * per * dtype.itemsize)  # no more is ever held
        block = np.frombuffer(raw, dtype, rows * tw * per).reshape(rows, tw, per)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=dtype.newbyteorder("="))
        part = block[: height - y, : width - x]
        image[y : y + part.shape[0], x : x + part.shape[1], plane if planes > 1 else slice(None)] = part[:, :, 0] if planes > 1 else part
    return Page(index, width, height, channels, bits, kind, tiled, image.tobytes())


def write_pages(images: list[np.ndarray], *, compression: int = DEFLATE, predictor: int = 2, rows: int | None = None, tile: int | None = None, order: str = "<") -> bytes:
    """A TIFF file of 8-bit grayscale images; in tiles of `tile` (a multiple of 16) or strips of `rows` rows."""
    out = bytearray({"<": b"II*\0", ">": b"MM\0*"}[order] + b"\0" * 4)
    link = 4
    for image in images:
        height, width = image.shape
        th, tw = (tile, tile) if tile else (rows or height, width)
        offsets, sizes = [], []
        for y in range(0, height, th):
            for x in range(0, width, tw):
                block = image[y : y + th, x : x + tw]
                if tile:
                    block = np.pad(block, ((0, th - block.shape[0]), (0, tw - block.shape[1])))
                if predictor == 2:
                    block = np.diff(block, axis=1, prepend=np.zeros((block.shape[0], 1), np.uint8))
                piece = ENCODE[compression](block.tobytes())
                offsets.append(len(out))
                sizes.append(len(piece))
                out += piece + b"\0" * (len(piece) % 2)
        fields = {WIDTH: [width], HEIGHT: [height], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
        fields |= {TILE_WIDTH: [tile], TILE_HEIGHT: [tile], TILE_OFFSETS: offsets, TILE_BYTES: sizes} if tile else {STRIP_OFFSETS: offsets, ROWS_PER_STRIP: [th], STRIP_BYTES: sizes}
        entries = []
        for tag, values in sorted(fields.items()):
            body = struct.pack(f"{order}{len(values)}I", *values)
            if len(body) > 4:
                place, body = len(out), body
                out += body
                body = struct.pack(order + "I", place)
            entries.append(struct.pack(order + "HHI", tag, 4, len(values)) + body)
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0" * 4
    return bytes(out)


def pages(media: DataFrame, *, column="media", keep=("doc_id",), max_page: int = 1 << 28) -> DataFrame:
    """One row per page of every file in column: keep, page, width, height, channels, bits, compression, tiled, samples, error."""
    extra = "page int, width int, height int, channels int, bits int, compression int, tiled boolean, samples binary, error string"
    schema = pa.schema([("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("bits", pa.int32()), ("compression", pa.int32()), ("tiled", pa.bool_()), ("samples", pa.binary()), ("error", pa.string())])
    keep = [c for c in keep if c.lower() not in schema.names]
    read = media.select(*keep, F.col(column).alias("_media"))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in read.schema[:-1]]

    def rows_of(data: bytes) -> Iterator[tuple]:
        failed = lambda index, e: (index, *[None] * 7, f"{type(e).__name__}: {e}"[:200])
        try:
            for index, (order, f) in enumerate(directories(data)):
                try:
                    p = read_page(data, index, order, f, max_page)
                    yield (p.index, p.width, p.height, p.channels, p.bits, p.compression, p.tiled, p.samples, None)
                except BROKEN as e:
                    yield failed(index, e)
        except BROKEN as e:
            yield failed(-1, e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(batch, rows, owner):
            new = [pa.array([r[j] for r in rows], f.type) for j, f in enumerate(schema)]
            return pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(owner, pa.int64())) for c in keep), *new], names=[*keep, *schema.names])

        for batch in bounded(batches, "_media", 4 << 20):
            rows, owner, size = [], [], 0
            for i, data in enumerate(batch.column("_media").to_pylist()):
                for row in rows_of(data) if data is not None else ():
                    rows.append(row)
                    owner.append(i)
                    size += len(row[7] or b"")
                    if size > 64 << 20:
                        yield made(batch, rows, owner)
                        rows, owner, size = [], [], 0
            yield made(batch, rows, owner)

    return read.mapInArrow(run, ", ".join([*kept, extra]))


# The contract's query: a text as the samples of a TIFF file and back.
UNIT, ROW, ROWS_PER_PAGE, ROWS_IN_STRIP = 576, 48, 4096, 512


def payload(text: bytes | None) -> bytes:
    """UTF-8 bytes, filled with 255 to a positive multiple of 576."""
    text = text or b""
    return text + b"\xff" * (max(1, -(-len(text) // UNIT)) * UNIT - len(text))


def store(data: bytes) -> bytes:
    """The payload in rows of 48 samples, pages of up to 4096 rows, deflated strips under a predictor."""
    image = np.frombuffer(data, np.uint8).reshape(-1, ROW)
    return write_pages([image[a : a + ROWS_PER_PAGE] for a in range(0, len(image), ROWS_PER_PAGE)], rows=ROWS_IN_STRIP)


def texts_to_media(docs: DataFrame, *, text="text", key="doc_id") -> DataFrame:
    """key, n_bytes and media (a TIFF file) for every text."""
    kept = docs.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, text, 4 << 20):
            texts = as_bytes(batch.column(text))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([len(x or b"") for x in texts], pa.int64()), pa.array([store(payload(x)) for x in texts], pa.binary())], names=[key, "n_bytes", "media"])

    return kept.mapInArrow(run, f"`{key}` {kept.schema[0].dataType.simpleString()}, n_bytes long, media binary")


def digests(media: DataFrame, *, key="doc_id") -> DataFrame:
    """What the contract asks for, from the stored bytes read page by page."""
    columns = [("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("n_pages", pa.int32())]

    def one(data: bytes) -> tuple:
        found = list(read_pages(data))
        body = b"".join(p.samples for p in found)
        a = np.frombuffer(body, np.uint8)
        share = np.bincount(a >> 5, minlength=8) * 1000 // len(a)
        feature = f"{found[0].width}x{sum(p.height for p in found)};mean={int(a.sum(dtype=np.int64)) * 1000 // len(a)};hist={','.join(map(str, share))}"
        return len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature, len(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, "media", 4 << 20):
            rows = [one(x) for x in batch.column("media").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), batch.column("n_bytes"), *(pa.array([r[j] for r in rows], t) for j, (_, t) in enumerate(columns))], names=[key, "n_bytes", *(c for c, _ in columns)])

    kind = media.schema[key].dataType.simpleString()
    return media.select(key, "n_bytes", "media").mapInArrow(run, f"`{key}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_pages int")


def op6_tiff_media(docs: DataFrame) -> DataFrame:
    return digests(texts_to_media(docs))
