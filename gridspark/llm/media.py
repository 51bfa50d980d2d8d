"""TIFF media columns: writing and reading multi-page images without an imaging library.

`pages` walks the chain of image directories of a file, gathers each page's strips or tiles, undoes PackBits, LZW or deflate
and the horizontal predictor, and gives the pixels of each page. `tiff_pages` emits one row per page of a binary column.
`store` turns any byte string into a greyscale TIFF, losslessly, and `digest` stores, reads back page by page and describes texts.

Null media have no rows; files that break off, carry an unknown compression or are no TIFF raise ValueError in `pages` and give
one row with page -1 and the reason in `error` in `tiff_pages`, so that nothing is lost silently. Repeated rows give repeated
pages. Null texts are stored as empty ones.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import SLICE_BYTES, map_slices, slices

#: Tags and codes of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIPS, SAMPLES, ROWS, STRIP_BYTES, PLANAR, PREDICTOR = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH, TILE_HEIGHT, TILES, TILE_BYTES = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


#: More pixels than any of the compressions makes of a byte; bounds the memory that a damaged header can ask for.
LARGEST_RATIO = 4096


class Page(NamedTuple):
    page: int
    width: int
    height: int
    samples: int
    compression: int
    pixels: bytes


def pack_bits(data: bytes) -> bytes:
    """Runs of two or more equal bytes become (1 - n, byte); what lies between becomes (n - 1, bytes)."""
    out, at, n = bytearray(), 0, len(data)
    plain = 0
    def flush(end):
        nonlocal plain
        while plain < end:
            step = min(128, end - plain)
            out.append(step - 1)
            out.extend(data[plain : plain + step])
            plain += step
    while at < n:
        run = 1
        while at + run < n and run < 128 and data[at + run] == data[at]:
            run += 1
        if run > 2:
            flush(at)
            out.append(257 - run)
            out.append(data[at])
            plain = at + run
        at += run
    flush(n)
    return bytes(out)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        head = data[at]
        at += 1
        if head < 128:
            out += data[at : at + head + 1]
            at += head + 1
        elif head > 128:
            out += data[at : at + 1] * (257 - head)
            at += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, most significant bit first; the width grows one code early, as the format asks."""
    bits = held = 0
    out = bytearray()

    def put(code, width):
        nonlocal bits, held
        bits, held = bits << width | code, held + width
        while held >= 8:
            held -= 8
            out.append(bits >> held & 255)
        bits &= (1 << held) - 1

    def fresh():
        return {bytes([i]): i for i in range(256)}

    known, following, width = fresh(), 258, 9
    put(256, 9)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in known:
            word = longer
            continue
        put(known[word], width)
        known[longer] = following
        following += 1
        if following == 4094:
            put(256, width)
            known, following, width = fresh(), 258, 9
        elif following + 1 > 1 << width:
            width += 1
        word = data[i : i + 1]
    if word:
        put(known[word], width)
        following += 1
        if following + 1 > 1 << width and width < 12:
            width += 1
    put(257, width)
    if held:
        out.append(bits << 8 - held & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    out, table, width, last = bytearray(), [], 9, b""
    bits = held = 0
    for byte in data:
        bits, held = bits << 8 | byte, held + 8
        while held >= width:
            held -= width
            code = bits >> held
            bits &= (1 << held) - 1
            if code == 257:
                return bytes(out)
            if code == 256 or not table:
                table, width, last = [bytes([i]) for i in range(256)] + [b"", b""], 9, b""
                if code == 256:
                    continue
            if code < len(table):
                word = table[code]
            elif last and code == len(table):
                word = last + last[:1]
            else:
                raise ValueError("an LZW code before its time")
            out += word
            if last:
                table.append(last + word[:1])
            last = word
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
            if len(out) >= size:
                return bytes(out)
    return bytes(out)


def squeeze(data: bytes, compression: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return pack_bits(data)
    if compression == LZW:
        return lzw_encode(data)
    if compression in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, 1)
    raise ValueError(f"compression {compression} is unknown")


def expand(data: bytes, compression: int, size: int) -> bytes:
    if compression == NONE:
        return data
    if compression == PACKBITS:
        return unpack_bits(data, size)
    if compression == LZW:
        return lzw_decode(data, size)
    if compression in (DEFLATE, OLD_DEFLATE):
        try:
            return zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise ValueError(str(e)) from None
    raise ValueError(f"compression {compression} is unknown")


def write_tiff(images: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, strip_rows: int = 256, tile: tuple[int, int] | None = None) -> bytes:
    """A little-endian file with one 8-bit page per array (rows, columns[, samples]); in strips, or in tiles of (rows, columns)."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    for image in images:
        image = np.atleast_3d(image.astype(np.uint8, copy=False))
        rows, columns, samples = image.shape
        if tile:
            blocks = []
            for r in range(0, rows, tile[0]):
                for c in range(0, columns, tile[1]):
                    block = np.zeros((*tile, samples), np.uint8)
                    piece = image[r : r + tile[0], c : c + tile[1]]
                    block[: piece.shape[0], : piece.shape[1]] = piece
                    blocks.append(block)
        else:
            blocks = [image[r : r + strip_rows] for r in range(0, rows, strip_rows)]
        where, sizes = [], []
        for block in blocks:
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            data = squeeze(block.tobytes(), compression)
            where.append(len(out))
            sizes.append(len(data))
            out += data
        out += b"\0" * (len(out) % 2)
        tags = {WIDTH: [columns], HEIGHT: [rows], BITS: [8] * samples, COMPRESSION: [compression], PHOTOMETRIC: [1 if samples < 3 else 2], SAMPLES: [samples], PLANAR: [1], PREDICTOR: [predictor]}
        tags |= {TILE_WIDTH: [tile[1]], TILE_HEIGHT: [tile[0]], TILES: where, TILE_BYTES: sizes} if tile else {STRIPS: where, ROWS: [strip_rows], STRIP_BYTES: sizes}
        entries = b""
        for tag, values in sorted(tags.items()):
            raw = struct.pack(f"<{len(values)}I", *values)
            if len(values) > 1:
                raw, at = struct.pack("<I", len(out)), raw
                out += at
            entries += struct.pack("<HHI", tag, 4, len(values)) + raw
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(tags)) + entries
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(media: bytes) -> Iterator[tuple[int, dict[int, list[int]]]]:
    """Number and tags of each directory of a file, in order."""
    order = {b"II": "<", b"MM": ">"}.get(bytes(media[:2]))
    if order is None or len(media) < 8 or struct.unpack_from(order + "H", media, 2)[0] != 42:
        raise ValueError("no TIFF header")
    try:
        at, seen, number = struct.unpack_from(order + "I", media, 4)[0], set(), 0
        while at:
            if at in seen:
                raise ValueError("the directories form a loop")
            seen.add(at)
            tags, at = _directory(media, order, at)
            yield number, tags
            number += 1
    except struct.error as e:
        raise ValueError(f"the file breaks off: {e}") from None


def pages(media: bytes) -> Iterator[Page]:
    """The pages of a file, in the order of its directories."""
    for number, tags in directories(media):
        yield _page(media, tags, number)


def _directory(media: bytes, order: str, at: int) -> tuple[dict[int, list[int]], int]:
    count = struct.unpack_from(order + "H", media, at)[0]
    tags = {}
    for k in range(count):
        here = at + 2 + 12 * k
        tag, kind, n = struct.unpack_from(order + "HHI", media, here)
        unit = FIELD_SIZE.get(kind, 1)
        place = here + 8 if unit * n <= 4 else struct.unpack_from(order + "I", media, here + 8)[0]
        if kind in (1, 3, 4):
            tags[tag] = list(struct.unpack_from(f"{order}{n}{' BxHI'[kind]}", media, place))
    return tags, struct.unpack_from(order + "I", media, at + 2 + 12 * count)[0]


def _page(media: bytes, tags: dict[int, list[int]], number: int) -> Page:
    one = lambda tag, default=None: (tags.get(tag) or [default])[0]
    columns, rows, samples = one(WIDTH), one(HEIGHT), one(SAMPLES, 1)
    if not columns or not rows or not samples or set(tags.get(BITS, [1])) != {8} or one(PLANAR, 1) != 1:
        raise ValueError("only chunky 8-bit pages with a size are read")
    if columns * rows * samples > LARGEST_RATIO * len(media):
        raise ValueError("the page is larger than its file can hold")
    compression, predictor = one(COMPRESSION, 1), one(PREDICTOR, 1)
    tiled = TILES in tags
    wide = one(TILE_WIDTH) if tiled else columns
    high = one(TILE_HEIGHT) if tiled else min(one(ROWS, rows), rows)
    if not wide or not high:
        raise ValueError("strips or tiles without a size")
    where, sizes = tags.get(TILES if tiled else STRIPS, []), tags.get(TILE_BYTES if tiled else STRIP_BYTES, [])
    across = -(-columns // wide)
    if len(where) != len(sizes) or len(where) < across * -(-rows // high):
        raise ValueError("strips or tiles are missing")
    image = np.zeros((rows, columns, samples), np.uint8)
    for k in range(across * -(-rows // high)):
        r, c = k // across * high, k % across * wide
        here = high if tiled else min(high, rows - r)
        size = here * wide * samples
        raw = expand(media[where[k] : where[k] + sizes[k]], compression, size)
        if len(raw) < size:
            raise ValueError("a strip or tile is too short")
        block = np.frombuffer(raw, np.uint8, size).reshape(here, wide, samples)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=np.uint8)
        elif predictor != 1:
            raise ValueError(f"predictor {predictor} is unknown")
        image[r : r + here, c : c + wide] = block[: rows - r, : columns - c]
    return Page(number, columns, rows, samples, compression, image.tobytes())


def tiff_pages(df: DataFrame, key: str = "doc_id", media: str = "media", carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, page, width, height, samples, compression, pixels, error, carry...), one row per page, a file's pages one after the other.

    A page that can't be read gives a row with its number and the error, and the next directory follows; page -1 is an error of the
    file, after which no directory is found.
    """
    src = df.select(key, media, *carry)
    kinds = dict(df.dtypes)
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = ", ".join([f"`{key}` {kinds[key]}, page int, width int, height int, samples int, compression int, pixels binary, error string", *(f"`{c}` {kinds[c]}" for c in carry)])
    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def of(data: bytes) -> Iterator[dict]:
        try:
            for number, tags in directories(data):
                try:
                    yield {**_page(data, tags, number)._asdict(), "error": None}
                except ValueError as e:
                    yield {"page": number, "error": str(e)}
        except ValueError as e:
            yield {"page": -1, "error": str(e)}

    def run(batches):
        out, held = [], 0
        for part in slices(batches):
            for row in part.to_pylist():
                if (data := row.pop(media)) is None:
                    continue
                for page in of(data):
                    out.append(row | page)
                    held += len(page.get("pixels", b""))
                    if held > SLICE_BYTES:
                        yield pa.RecordBatch.from_pylist(out, schema=arrow)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return src.mapInArrow(run, schema)


#: Pixels in a row and rows on a page of what `store` writes.
COLUMNS, PAGE_ROWS = 64, 1024


def store(payload: bytes) -> bytes:
    """A payload whose length is a positive multiple of COLUMNS, as pages of at most PAGE_ROWS rows.

    Its checksum chooses the form, so that a corpus has all of them: a sixteenth in strips of LZW, three in strips of PackBits, four
    in tiles and eight in strips of deflate, always with differences of neighbours but for PackBits.
    """
    image = np.frombuffer(payload, np.uint8).reshape(-1, COLUMNS)
    form = zlib.crc32(payload) % 16
    images = [image[r : r + PAGE_ROWS] for r in range(0, len(image), PAGE_ROWS)]
    if form == 0:
        return write_tiff(images, LZW, 2)
    if form < 4:
        return write_tiff(images, PACKBITS, 1)
    return write_tiff(images, DEFLATE, 2, tile=(64, 32) if form < 8 else None)


def stored(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media, media_bytes, media_sha256): each text's bytes, padded with zeros, as a TIFF."""

    def run(cols):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in cols[text]]
        media = [store(r.ljust(max(64, -(-len(r) // 64) * 64), b"\0")) for r in raw]
        return {key: cols[key], "n_bytes": list(map(len, raw)), "media": media, "media_bytes": list(map(len, media)), "media_sha256": [hashlib.sha256(m).hexdigest() for m in media]}

    return map_slices(df.select(key, text), run, f"`{key}` {dict(df.dtypes)[key]}, n_bytes long, media binary, media_bytes long, media_sha256 string")


def features(pixels: bytes, pages: int) -> str:
    """Pages, rows, the mean level in hundredths, and a 16-bit hash of which seventeenths of the pixels are lighter than the next."""
    level = np.frombuffer(pixels, np.uint8)
    bands = [int(b.sum()) * 4096 // max(len(b), 1) for b in np.array_split(level, 17)]
    sign = sum(1 << i for i in range(16) if bands[i] > bands[i + 1])
    return f"pages={pages};rows={len(level) // COLUMNS};mean={int(level.sum()) * 100 // len(level)};bands={sign:04x}"


def digest(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Stores each text as a TIFF, reads it back page by page, and describes both forms. A page that doesn't come back is an error."""
    pages = tiff_pages(stored(df, key, text), key, "media", ("n_bytes", "media_bytes", "media_sha256"))
    schema = f"`{key}` {dict(df.dtypes)[key]}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(df.sparkSession.createDataFrame([], schema).schema)

    def described(first: dict, parts: list[bytes]) -> dict:
        back = b"".join(parts)
        return {key: first[key], "n_bytes": first["n_bytes"], "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-64:]), "media_bytes": first["media_bytes"], "media_sha256": first["media_sha256"], "feature": features(back, len(parts))}

    def run(batches):
        first, parts, out = None, [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["error"]:
                    raise ValueError(f"page {row['page']}: {row['error']}")
                if row["page"] == 0:  # a file's pages follow one another, so this one begins the next file
                    if first:
                        out.append(described(first, parts))
                    first, parts = row, []
                parts.append(row.pop("pixels"))
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
                out = []
        if first:
            yield pa.RecordBatch.from_pylist([described(first, parts)], schema=arrow)

    return pages.mapInArrow(run, schema)
