"""Media columns: TIFF files in a binary column, written and read page by page.

The reader walks the chain of image directories, decodes uncompressed, PackBits, LZW and deflate strips or
tiles of 8-bit samples, undoes horizontal prediction and gives one row per page.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .shared import ship, table

WIDTH = 64
ROWS_PER_STRIP = 1024
#: Fixed values of the format: tag numbers, compression codes, bytes of each field type.
TAG_WIDTH, TAG_HEIGHT, TAG_BITS, TAG_COMPRESSION, TAG_PHOTOMETRIC = 256, 257, 258, 259, 262
TAG_STRIP_OFFSETS, TAG_SAMPLES, TAG_ROWS_PER_STRIP, TAG_STRIP_COUNTS, TAG_PLANAR, TAG_PREDICTOR = 273, 277, 278, 279, 284, 317
TAG_TILE_WIDTH, TAG_TILE_HEIGHT, TAG_TILE_OFFSETS, TAG_TILE_COUNTS = 322, 323, 324, 325
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8}
#: Decoded bytes that one byte of a file can stand for at most (deflate's bound is near 1032, PackBits' is 64;
#: an LZW code of 9 bits or more stands for fewer than 4,096): a header that claims more is damaged.
MOST_FROM_A_BYTE = 4096


class BadTiff(ValueError):
    """The bytes are not a TIFF file that this reader knows."""


def write_page(payload: bytes, width: int = WIDTH, predictor: int = 1) -> bytes:
    """A little-endian TIFF file of one page: payload as rows of 8-bit grey samples in deflate strips."""
    height = len(payload) // width
    if not payload or height * width != len(payload):
        raise ValueError(f"a payload is a positive multiple of {width} bytes")
    strips = []
    for at in range(0, len(payload), ROWS_PER_STRIP * width):
        strip = payload[at : at + ROWS_PER_STRIP * width]
        if predictor == 2:
            rows = np.frombuffer(strip, np.uint8).reshape(-1, width)
            strip = np.concatenate([rows[:, :1], np.diff(rows, axis=1)], axis=1).astype(np.uint8).tobytes()
        strips.append(zlib.compress(strip, 1))
    fields = [(TAG_WIDTH, [width]), (TAG_HEIGHT, [height]), (TAG_BITS, [8]), (TAG_COMPRESSION, [DEFLATE]), (TAG_PHOTOMETRIC, [1])]
    fields += [(TAG_STRIP_OFFSETS, None), (TAG_SAMPLES, [1]), (TAG_ROWS_PER_STRIP, [ROWS_PER_STRIP]), (TAG_STRIP_COUNTS, [len(s) for s in strips]), (TAG_PREDICTOR, [predictor])]
    at = 8 + 2 + 12 * len(fields) + 4  # where the values begin that don't fit into an entry
    extra = 8 * len(strips) if len(strips) > 1 else 0
    starts = np.cumsum([at + extra, *map(len, strips[:-1])]).tolist()
    out, tail = [struct.pack("<2sHIH", b"II", 42, 8, len(fields))], b""
    for tag, values in fields:
        values = starts if values is None else values
        packed = struct.pack(f"<{len(values)}I", *values)
        out.append(struct.pack("<HHI", tag, 4, len(values)) + (packed if len(values) == 1 else struct.pack("<I", at + len(tail))))
        tail += packed if len(values) > 1 else b""
    return b"".join([*out, struct.pack("<I", 0), tail, *strips])


def unpack_bits(data: bytes, expected: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < expected:
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += 2 + n
        else:
            if n > 128:
                out += data[i + 1 : i + 2] * (257 - n)
            i += 2 if n > 128 else 1
    return bytes(out)


def unpack_lzw(data: bytes, expected: int) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 clears the table, 257 ends; widths grow one code early."""
    out, entries, width, last, held, bits = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9, b"", 0, 0
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == 257:
            break
        if code == 256:
            del entries[258:]
            width, last = 9, b""
            continue
        if code > len(entries) or (code == len(entries) and not last):
            raise BadTiff("an LZW code that is not in the table")
        entry = entries[code] if code < len(entries) else last + last[:1]
        if last:
            entries.append(last + entry[:1])
        out += entry
        last = entry
        if len(out) >= expected:
            break
        width = 12 if len(entries) >= 2047 else 11 if len(entries) >= 1023 else 10 if len(entries) >= 511 else 9
    return bytes(out)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, tuple[int, ...]], int]:
    (n,) = struct.unpack_from(f"{order}H", data, at)
    fields = {}
    for k in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * k)
        width = FIELD_BYTES.get(kind)
        if width is None or kind in (2, 5):
            continue
        where = at + 10 + 12 * k
        if width * count > len(data):
            raise BadTiff("a field longer than its file")
        if width * count > 4:
            (where,) = struct.unpack_from(f"{order}I", data, where)
        fields[tag] = struct.unpack_from(f"{order}{count}{'BHI'[width // 2]}", data, where)
    return fields, struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]


def _samples(data: bytes, fields: dict, offset: int, count: int, rows: int, columns: int, samples: int) -> np.ndarray:
    raw, how, expected = data[offset : offset + count], fields.get(TAG_COMPRESSION, (NONE,))[0], rows * columns * samples
    if expected > MOST_FROM_A_BYTE * len(raw):
        raise BadTiff("a strip or tile is too short")
    if how == PACKBITS:
        raw = unpack_bits(raw, expected)
    elif how == LZW:
        raw = unpack_lzw(raw, expected)
    elif how in (DEFLATE, OLD_DEFLATE):
        raw = zlib.decompressobj().decompress(raw, expected)
    elif how != NONE:
        raise BadTiff(f"compression {how}")
    if len(raw) < expected:
        raise BadTiff("a strip or tile is too short")
    block = np.frombuffer(raw, np.uint8)[:expected].reshape(rows, columns, samples)
    predictor = fields.get(TAG_PREDICTOR, (1,))[0]
    if predictor == 2:
        block = np.cumsum(block, axis=1, dtype=np.uint8)
    elif predictor != 1:
        raise BadTiff(f"predictor {predictor}")
    return block


def _page(data: bytes, f: dict[int, tuple[int, ...]]) -> np.ndarray:
    """The samples of one directory. Its strips or tiles have to cover the page exactly, and the page has to be
    of a size that the file's bytes can hold, before anything is allocated."""
    width, height, samples = f[TAG_WIDTH][0], f[TAG_HEIGHT][0], f.get(TAG_SAMPLES, (1,))[0]
    if set(f.get(TAG_BITS, (1,))) != {8} or f.get(TAG_PLANAR, (1,))[0] != 1:
        raise BadTiff("only interleaved 8-bit samples are read")
    tiled = TAG_TILE_OFFSETS in f
    w, h = (f[TAG_TILE_WIDTH][0], f[TAG_TILE_HEIGHT][0]) if tiled else (width, min(f.get(TAG_ROWS_PER_STRIP, (height,))[0], height))
    if min(width, height, samples, w, h) < 1:
        raise BadTiff("a page, strip or tile without samples")
    offsets, counts = (f[TAG_TILE_OFFSETS], f[TAG_TILE_COUNTS]) if tiled else (f[TAG_STRIP_OFFSETS], f[TAG_STRIP_COUNTS])
    across, down = -(-width // w), -(-height // h)
    if not len(offsets) == len(counts) == across * down:
        raise BadTiff("strips or tiles that don't cover the page")
    if width * height * samples > MOST_FROM_A_BYTE * len(data) or w * h * samples > MOST_FROM_A_BYTE * len(data):
        raise BadTiff("a page larger than its file can hold")
    page = np.zeros((height, width, samples), np.uint8)
    for k, (o, n) in enumerate(zip(offsets, counts, strict=True)):
        y, x = k // across * h, k % across * w
        rows = h if tiled else min(h, height - y)
        page[y : y + h, x : x + w] = _samples(data, f, o, n, rows, w, samples)[: height - y, : width - x]
    return page


def read_tiff(data: bytes) -> Iterator[np.ndarray]:
    """The pages in file order, each as rows x columns x samples of 8 bits. Raises BadTiff."""
    try:
        order = {b"II": "<", b"MM": ">"}[bytes(data[:2])]
        magic, at = struct.unpack_from(f"{order}HI", data, 2)
        if magic != 42:
            raise BadTiff("no TIFF header")
        seen = set()
        while at and at not in seen:
            seen.add(at)
            f, at = _directory(data, at, order)
            yield _page(data, f)
    except (KeyError, struct.error, zlib.error, IndexError, ValueError, MemoryError) as error:
        raise error if isinstance(error, BadTiff) else BadTiff(f"{type(error).__name__}: {error}") from error


def _in_pieces(batch: pa.RecordBatch, column: int, max_bytes: int = 2_000_000) -> Iterator[pa.RecordBatch]:
    size = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(size):
        before = size[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(size, before + max_bytes, side="right")))
        yield batch.slice(at, stop - at)
        at = stop


def encode_texts(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """keep columns, ``n_bytes`` and ``media``: the text's UTF-8 bytes, padded with zero bytes to a positive
    multiple of 64, as a one-page TIFF file. A null text is an empty one; equal texts give equal files. keep columns
    with the name of a made one are replaced."""
    ship(df.sparkSession)
    keep = [c for c in keep if c not in ("n_bytes", "media", "_text")]
    rows = df.select(*keep, df[text].alias("_text"))

    def run(batches):
        for whole in batches:
            for b in _in_pieces(whole, len(keep)):
                raw = [t.encode() if t else b"" for t in b.column(len(keep)).to_pylist()]
                files = [write_page(t + bytes(-len(t) % WIDTH or (0 if t else WIDTH))) for t in raw]
                yield pa.RecordBatch.from_arrays([*b.columns[: len(keep)], pa.array(map(len, raw), pa.int64()), pa.array(files, pa.binary())], names=[*keep, "n_bytes", "media"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(keep)])
    return rows.mapInArrow(run, f"{schema}{', ' * bool(keep)}n_bytes long, media binary")


MADE = ["page", "width", "height", "samples", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error", "pixels"]


def read_pages(df: DataFrame, media: str, keep: list[str], pixels: bool = False) -> DataFrame:
    """One row per page of each file: keep columns, page (from 0), width, height, samples, payload_bytes,
    payload_sha256, tail_crc32 (of the last 64 samples), media_bytes, media_sha256, feature and error; with
    pixels also the samples. A null, empty or damaged file gives its pages up to the damage and then one row
    with page null and error set. keep columns with the name of a made one are replaced."""
    ship(df.sparkSession)
    keep = [c for c in keep if c not in MADE and c != "_media"]
    rows = df.select(*keep, df[media].alias("_media"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[: len(keep)])
    schema = f"{kept}{', ' * bool(keep)}page int, width int, height int, samples int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string" + ", pixels binary" * pixels

    def run(batches):
        kinds = [pa.int32()] * 4 + [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.binary()] * pixels
        names = [*keep, *MADE[:-1]] + ["pixels"] * pixels
        for whole in batches:
            for b in _in_pieces(whole, len(keep)):
                at, out = [], []
                for i, data in enumerate(b.column(len(keep)).to_pylist()):
                    data = data or b""
                    file = (len(data), hashlib.sha256(data).hexdigest())
                    try:
                        for page, block in enumerate(read_tiff(data)):
                            raw, (h, w, n) = block.tobytes(), block.shape
                            feature = f"{w}x{h}x{n} mean={block.mean():.6f} deviation={block.std():.6f} levels={len(np.flatnonzero(np.bincount(block.ravel(), minlength=1)))}"
                            out.append((page, w, h, n, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), *file, feature, None) + (raw,) * pixels)
                            at.append(i)
                    except BadTiff as error:
                        out.append((None,) * 7 + (*file, None, str(error)) + (None,) * pixels)
                        at.append(i)
                columns = [b.column(k).take(pa.array(at, pa.int64())) for k in range(len(keep))]
                columns += [pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, schema)


def op10_media(spark, sf_dir: str) -> DataFrame:
    """Every document's text as a TIFF file and what the reader finds in it."""
    files = encode_texts(table(spark, sf_dir, "documents"), "text", ["doc_id"])
    return read_pages(files, "media", ["doc_id", "n_bytes"]).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
