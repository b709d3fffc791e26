"""TIFF media: pages out of bytes, and bytes into pages.

The reader walks the chain of image directories, decodes strips or tiles (stored, PackBits, LZW, deflate), undoes
horizontal differencing and crops tiles to the image; each directory becomes one row. The writer makes such files
from 8-bit samples. Directories that point back end the walk; damaged files give an error text and no pages, and so do files that
declare more samples than their bytes can hold, or more than MOST_SAMPLES.

A text is stored as pages of PAGE_ROWS rows. Where it begins in the list of layouts, and the byte order, follow from a checksum of its
bytes; its pages then take the layouts in turn. So texts of any size go through every compression, strips and tiles, and both predictors.

Null or empty media has no pages. Equal media give equal pages. Very long texts have more pages, each read on its own; an empty table gives an
empty result. Other columns are left alone, whatever their names; the columns added replace columns of their names.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from capwindow.llm import common

#: Values of the TIFF 6.0 specification.
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_BYTES, PREDICTOR = 273, 277, 278, 279, 317
TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES = 322, 323, 324, 325
FIELD_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}
CLEAR, END = 256, 257
SINGLE = [*(bytes((i,)) for i in range(256)), b"", b""]
#: What PackBits repeats.
RUN = re.compile(rb"(.)\1{2,}", re.DOTALL)

#: The payload is filled up to a multiple of UNIT bytes, which are so many rows of ROW samples; so many rows a page, at most.
UNIT, ROW, PAGE_ROWS = 576, 48, 48
#: How pages are stored, in turn: compression, tiled, predictor. Strips and tiles have DOWN rows; a tile is as wide as a page.
LAYOUTS = tuple((compression, tiled, predictor) for tiled in (False, True) for predictor in (1, 2) for compression in (PACKBITS, LZW, DEFLATE))
DOWN = 16
#: Samples of a file that is read, at most, and of a strip or tile for each of its stored bytes: LZW's longest pieces stand behind 12 bits.
MOST_SAMPLES, MOST_RATIO = 1 << 30, 4096

PAGE = "struct<page:int,width:int,height:int,compression:int,tiled:boolean,predictor:int,samples:binary,mean:double,distinct:int>"


def packbits_encode(data: bytes) -> bytes:
    """Runs of three bytes or more as repeats of at most 128, everything else as literals of at most 128."""
    out, at = bytearray(), 0
    for run in [*RUN.finditer(data), None]:
        start, end = run.span() if run else (len(data), len(data))
        while at < start:
            n = min(128, start - at)
            out.append(n - 1)
            out += data[at : at + n]
            at += n
        while at < end:
            n = min(128, end - at)
            out += bytes((257 - n if n > 1 else 0, data[at]))
            at += n
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        head = data[at]
        if head < 128:
            out += data[at + 1 : at + 2 + head]
            at += 2 + head
        elif head > 128:
            out += data[at + 1 : at + 2] * (257 - head)
            at += 2
        else:
            at += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bit first, widened one code early. Strings are known by their prefix's code and last byte."""
    table: dict[int, int] = {}
    width, following, bits, n_bits, out = 9, 258, CLEAR, 9, []
    prefix = data[0] if data else -1
    for byte in data[1:]:
        longer = prefix << 8 | byte
        if longer in table:
            prefix = table[longer]
            continue
        bits, n_bits, prefix = bits << width | prefix, n_bits + width, byte
        table[longer] = following
        following += 1
        if following == 4095:
            bits, n_bits = bits << width | CLEAR, n_bits + width
            table, width, following = {}, 9, 258
        elif following == 1 << width:
            width += 1
        if n_bits > 256:
            rest = n_bits & 7
            out.append((bits >> rest).to_bytes(n_bits >> 3, "big"))
            bits, n_bits = bits & ((1 << rest) - 1), rest
    if prefix >= 0:
        bits, n_bits = bits << width | prefix, n_bits + width
        if following + 1 == 1 << width and width < 12:
            width += 1
    bits, n_bits = bits << width | END, n_bits + width
    fill = -n_bits % 8
    out.append((bits << fill).to_bytes((n_bits + fill) >> 3, "big"))
    return b"".join(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes are unpacked by stretches of the same width, which the number of codes tells."""
    bits, at = np.unpackbits(np.frombuffer(data, np.uint8)), 0
    table, out, total, width, last = SINGLE.copy(), [], 0, 9, b""
    while total < size and at + width <= len(bits):
        most = 4096 if width == 12 else (1 << width) - 1 - len(table) + (not last)
        n = min((len(bits) - at) // width, most)
        codes = (bits[at : at + n * width].reshape(n, width) @ (1 << np.arange(width - 1, -1, -1, dtype=np.int32))).tolist()
        at += n * width
        for k, code in enumerate(codes):
            if code == CLEAR or code == END:
                at -= (n - k - 1) * width
                break
            if code < len(table):
                piece = table[code]
            elif code == len(table) and last:
                piece = last + last[:1]
            else:
                raise ValueError("LZW code out of range")
            if last:
                table.append(last + piece[:1])
            out.append(piece)
            total += len(piece)
            last = piece
            if total >= size:
                return b"".join(out)
        else:
            width += width < 12 and len(table) == (1 << width) - 1
            continue
        if code == END:
            break
        table, width, last = SINGLE.copy(), 9, b""
    return b"".join(out)


def compress(data: bytes, compression: int) -> bytes:
    if compression == PACKBITS:
        return packbits_encode(data)
    if compression == LZW:
        return lzw_encode(data)
    return zlib.compress(data, 1) if compression in (DEFLATE, OLD_DEFLATE) else data


def expand(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        out = data
    elif compression == PACKBITS:
        out = packbits_decode(data, size)
    elif compression == LZW:
        out = lzw_decode(data, size)
    elif compression in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size)
    else:
        raise ValueError(f"compression {compression}")
    if len(out) < size:
        raise ValueError("a strip or tile is too short")
    return out[:size]


def blocks_of(image: np.ndarray, tiled: bool, down: int, across: int) -> list[np.ndarray]:
    """Strips of down rows, or tiles of down by across samples padded with zeros."""
    height, width = image.shape
    if not tiled:
        return [image[r : r + down] for r in range(0, height, down)]
    full = np.zeros((math.ceil(height / down) * down, math.ceil(width / across) * across), np.uint8)
    full[:height, :width] = image
    return [full[r : r + down, c : c + across] for r in range(0, full.shape[0], down) for c in range(0, full.shape[1], across)]


def write_tiff(pages: list[tuple[np.ndarray, int, bool, int]], down: int = 64, across: int = 64, order: str = "<") -> bytes:
    """A file of one-sample images in this byte order: (samples by rows, compression, tiled, predictor) a page."""
    out = bytearray(b"II*\0" if order == "<" else b"MM\0*") + bytes(4)
    link = 4
    for image, compression, tiled, predictor in pages:
        offsets, counts = [], []
        for block in blocks_of(image, tiled, down, across):
            if predictor == 2:
                block = np.diff(block, axis=1, prepend=np.zeros((block.shape[0], 1), np.uint8))
            stored = compress(block.tobytes(), compression)
            offsets.append(len(out))
            counts.append(len(stored))
            out += stored
        where = (TILE_OFFSETS, TILE_BYTES) if tiled else (STRIP_OFFSETS, STRIP_BYTES)
        tags = {WIDTH: [image.shape[1]], LENGTH: [image.shape[0]], BITS: [8], COMPRESSION: [compression], PHOTOMETRIC: [1], SAMPLES: [1], PREDICTOR: [predictor]}
        tags |= {where[0]: offsets, where[1]: counts} | ({TILE_WIDTH: [across], TILE_LENGTH: [down]} if tiled else {ROWS_PER_STRIP: [down]})
        entries = bytearray()
        for tag, values in sorted(tags.items()):
            packed = struct.pack(f"{order}{len(values)}I", *values)
            if len(values) > 1:
                out += b"\0" * (len(out) % 2)
                packed, place = struct.pack(f"{order}I", len(out)), packed
                out += place
            entries += struct.pack(f"{order}HHI", tag, 4, len(values)) + packed
        out += b"\0" * (len(out) % 2)
        struct.pack_into(f"{order}I", out, link, len(out))
        out += struct.pack(f"{order}H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directory(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    """The integer fields of the directory at this offset, and the offset of the next."""
    (n,) = struct.unpack_from(f"{order}H", data, at)
    fields: dict[int, list[int]] = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
        if kind not in (1, 3, 4):
            continue
        place = at + 10 + 12 * i
        if count * FIELD_SIZE[kind] > 4:
            (place,) = struct.unpack_from(f"{order}I", data, place)
        if place + count * FIELD_SIZE[kind] > len(data):
            raise ValueError("a field is beyond the file")
        fields[tag] = list(struct.unpack_from(f"{order}{count}{'BxHI'[kind - 1]}", data, place))
    return fields, struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]


def image_of(data: bytes, fields: dict[int, list[int]], most: int) -> np.ndarray:
    """The samples of one page by rows; the samples of a pixel stand together. What the page declares is checked before memory is taken."""
    one = lambda tag, default: fields.get(tag, [default])[0]
    width, height, depth = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1)
    if any(b != 8 for b in fields.get(BITS, [1])):
        raise ValueError("only 8-bit samples")
    tiled = TILE_OFFSETS in fields
    across, down = (one(TILE_WIDTH, 0), one(TILE_LENGTH, 0)) if tiled else (width, min(one(ROWS_PER_STRIP, height), height))
    offsets, counts = (fields[TILE_OFFSETS], fields[TILE_BYTES]) if tiled else (fields[STRIP_OFFSETS], fields[STRIP_BYTES])
    if not min(width, height, depth, across, down):
        raise ValueError("an empty image")
    if -(-height // down) * -(-width // across) != len(offsets) or len(offsets) != len(counts):
        raise ValueError("strips or tiles don't cover the image")
    full = (-(-height // down) * down, -(-width // across) * across, depth)
    if math.prod(full) > most:
        raise ValueError("too many samples")
    if any(across * min(down, full[0] if tiled else height) * depth > MOST_RATIO * max(1, count) for count in counts[: -1 if len(counts) > 1 else None]):
        raise ValueError("more samples than the bytes can hold")
    out = np.zeros(full, np.uint8)
    places = [(r, c) for r in range(0, full[0], down) for c in range(0, full[1], across)]
    for (r, c), offset, count in zip(places, offsets, counts):
        rows = down if tiled else min(down, height - r)
        raw = expand(data[offset : offset + count], one(COMPRESSION, NONE), rows * across * depth)
        block = np.frombuffer(raw, np.uint8).reshape(rows, across, depth)
        if one(PREDICTOR, 1) == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        out[r : r + rows, c : c + across] = block
    return out[:height, :width].reshape(height, width * depth)


def read_tiff(data: bytes) -> list[dict]:
    """One dictionary a page, in the order of the directories."""
    if data[:4] not in (b"II*\0", b"MM\0*"):
        raise ValueError("not a TIFF file")
    order = "<" if data[:2] == b"II" else ">"
    (at,) = struct.unpack_from(f"{order}I", data, 4)
    pages, seen, left = [], set(), MOST_SAMPLES
    while at and at not in seen:
        seen.add(at)
        fields, at = directory(data, at, order)
        image = image_of(data, fields, left)
        left -= image.size
        depth = fields.get(SAMPLES, [1])[0]
        pages.append(
            {"page": len(pages), "width": image.shape[1] // depth, "height": image.shape[0], "compression": fields.get(COMPRESSION, [NONE])[0], "tiled": TILE_OFFSETS in fields, "predictor": fields.get(PREDICTOR, [1])[0]}
            | {"samples": image.tobytes(), "mean": round(float(image.mean()), 6), "distinct": int(np.count_nonzero(np.bincount(image.ravel(), minlength=256)))}
        )
    return pages


def text_to_tiff(text: str | None) -> bytes:
    """The text's bytes, filled with 255 to whole units (at least one), as pages of at most PAGE_ROWS rows."""
    raw = (text or "").encode()
    payload = np.full(max(1, -(-len(raw) // UNIT)) * UNIT, 255, np.uint8)
    payload[: len(raw)] = np.frombuffer(raw, np.uint8)
    image, first = payload.reshape(-1, ROW), zlib.crc32(payload)
    pages = [(image[r : r + PAGE_ROWS], *LAYOUTS[(first + i) % len(LAYOUTS)]) for i, r in enumerate(range(0, len(image), PAGE_ROWS))]
    return write_tiff(pages, DOWN, ROW, "<" if first & (1 << 31) else ">")


def _encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([text_to_tiff(x.as_py()) for x in batch], pa.binary())


def _decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    page = pa.struct([("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("compression", pa.int32()), ("tiled", pa.bool_()), ("predictor", pa.int32()), ("samples", pa.binary()), ("mean", pa.float64()), ("distinct", pa.int32())])
    kind = pa.struct([("error", pa.string()), ("pages", pa.list_(page))])
    for batch in batches:
        out = []
        for x in batch:
            data, error, pages = x.as_py(), None, []
            if data:
                try:
                    pages = read_tiff(data)
                except (ValueError, KeyError, IndexError, ZeroDivisionError, struct.error, zlib.error, MemoryError, OverflowError) as e:
                    error = str(e) or type(e).__name__
            out.append({"error": error, "pages": pages})
        yield pa.array(out, kind)


def with_media(df: DataFrame, text_col: str = "text", out: str = "media") -> DataFrame:
    """df with its texts stored as TIFF files; null texts are stored as empty ones."""
    common.small_batches(df.sparkSession)
    # Called not deterministic, so that Spark keeps one evaluation where the media is read more than once.
    return df.withColumn(out, F.arrow_udf(_encode, "binary").asNondeterministic()(F.col(text_col)))


def with_pages(df: DataFrame, media_col: str = "media", out: str = "tiff") -> DataFrame:
    """df with the struct (error, array of pages) of its media."""
    common.small_batches(df.sparkSession)
    return df.withColumn(out, F.arrow_udf(_decode, f"struct<error:string,pages:array<{PAGE}>>")(F.col(media_col)))


def page_rows(df: DataFrame, media_col: str = "media", out: str = "page") -> DataFrame:
    """One row a page: df's columns without the media, and the page as a struct."""
    hidden = common.free_name(df, "tiff_pages")
    read = with_pages(df, media_col, hidden).drop(media_col)
    return read.withColumn(out, F.explode(F.col(hidden)["pages"])).drop(hidden)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = with_media(docs).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "media")
    pages = F.col("tiff")["pages"]
    # Hexadecimal pieces join in linear time; concatenating binary ones in a fold would copy the start again and again.
    payload = F.unhex(F.array_join(F.transform(pages, lambda p: F.hex(p["samples"])), ""))
    read = with_pages(stored).select(
        "doc_id",
        "n_bytes",
        payload.alias("payload"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.array_join(
            F.transform(pages, lambda p: F.concat_ws(":", F.concat_ws("x", p["width"], p["height"]), p["distinct"], F.format_number(p["mean"], 6))), ";"
        ).alias("feature"),
    )
    return read.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, octet_length(payload) - 31, 32)")).alias("tail_crc32"),
        "media_bytes",
        "media_sha256",
        "feature",
    )
