"""Media columns: Netpbm and BMP bytes to numpy arrays, NPY tiles and difference hashes.

Images are read into arrays of (rows, columns, channels) samples. Area resizing
takes each target pixel's mean from an integral image, with exact shares of the
pixels that a target's edge cuts. Tiles are NPY files' bytes, written and read
without numpy's pickling.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from treequill.llm import textvec
from treequill.llm.common import table

#: Bytes that a payload is padded to a multiple of, and the byte it is padded with.
BLOCK, FILL = 576, b"\xff"
#: Columns of the images that payloads are stored as; 24 rows make a block.
WIDTH = 24
#: Sides of the tile that is kept of an image.
TILE = 16


class MediaError(ValueError):
    """Bytes that are no image of the handled formats."""


# Netpbm: P1 to P6, plain and raw, 8 or 16 bits.


def _fields(data: bytes, at: int, count: int) -> tuple[list[int], int]:
    """``count`` numbers of a Netpbm header and the place after them; comments run to the line's end."""
    out: list[int] = []
    while len(out) < count:
        while at < len(data) and (data[at : at + 1].isspace() or data[at : at + 1] == b"#"):
            if data[at : at + 1] == b"#":
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            at += 1
        end = at
        while end < len(data) and data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise MediaError("a number is missing in the header")
        out.append(int(data[at:end]))
        at = end
    return out, at


def read_netpbm(data: bytes) -> np.ndarray:
    if len(data) < 3 or data[:1] != b"P" or data[1:2] not in b"123456":
        raise MediaError("not a Netpbm image")
    kind = data[1] - 48
    bitmap, channels = kind in (1, 4), 3 if kind in (3, 6) else 1
    numbers, at = _fields(data, 2, 2 if bitmap else 3)
    width, height, most = numbers[0], numbers[1], 1 if bitmap else numbers[2]
    if width < 1 or height < 1 or not 1 <= most <= 65535:
        raise MediaError("impossible size or depth")
    kind_of = np.uint8 if most < 256 else np.uint16
    count = width * height * channels
    if kind <= 3:
        body = b"\n".join(line.split(b"#")[0] for line in data[at:].split(b"\n"))
        digits = np.frombuffer(body.translate(None, b" \t\r\n\x0b\x0c"), dtype=np.uint8) - 48 if bitmap else np.array(body.split(), dtype=np.int64)
        values = digits[:count]
    else:
        raw = data[at + 1 :]
        if bitmap:
            stride = (width + 7) // 8
            if len(raw) < stride * height:
                raise MediaError("samples are missing")
            values = np.unpackbits(np.frombuffer(raw, np.uint8, stride * height).reshape(height, stride), axis=1)[:, :width].ravel()
        else:
            size = 1 if most < 256 else 2
            if len(raw) < count * size:
                raise MediaError("samples are missing")
            values = np.frombuffer(raw, ">u1" if size == 1 else ">u2", count)
    if len(values) < count:
        raise MediaError("samples are missing")
    out = values.astype(kind_of).reshape(height, width, channels)
    if out.max(initial=0) > most:
        raise MediaError("a sample exceeds the depth")
    return 1 - out if bitmap else out  # in bitmaps 1 is black


def write_netpbm(image: np.ndarray) -> bytes:
    """Raw PGM or PPM of 8-bit samples."""
    height, width, channels = image.shape
    if image.dtype != np.uint8 or channels not in (1, 3):
        raise MediaError("only 8-bit grey and RGB are written")
    return b"P%d\n%d %d\n255\n" % (5 if channels == 1 else 6, width, height) + image.tobytes()


# BMP: uncompressed 1, 4, 8, 24 and 32 bits, bottom-up and top-down.


def read_bmp(data: bytes) -> np.ndarray:
    if len(data) < 54 or data[:2] != b"BM":
        raise MediaError("not a BMP image")
    start, header = struct.unpack_from("<II", data, 10)
    if header < 40:
        raise MediaError("the old core header isn't handled")
    width, height, _, bits, packing, _, _, _, used, _ = struct.unpack_from("<iiHHIIiiII", data, 18)
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32) or width < 1 or height == 0:
        raise MediaError("compression, depth or size isn't handled")
    stride, rows = (width * bits + 31) // 32 * 4, abs(height)
    if len(data) < start + stride * rows:
        raise MediaError("samples are missing")
    lines = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    if height > 0:
        lines = lines[::-1]
    if bits >= 24:
        return np.ascontiguousarray(lines[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1])
    if bits == 8:
        index = lines[:, :width]
    else:
        index = np.unpackbits(lines, axis=1).reshape(rows, -1, bits) @ (1 << np.arange(bits - 1, -1, -1, dtype=np.uint8)).astype(np.uint8)
        index = index[:, :width]
    colours = used or 1 << bits
    if len(data) < 14 + header + 4 * colours or int(index.max(initial=0)) >= colours:
        raise MediaError("the palette is too short")
    palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + header).reshape(-1, 4)[:, 2::-1]
    grey = (palette == palette[:, :1]).all()
    return np.ascontiguousarray(palette[index][:, :, :1] if grey else palette[index])


def write_bmp(image: np.ndarray) -> bytes:
    """8-bit BMP with a grey palette, or 24-bit BMP, bottom-up."""
    height, width, channels = image.shape
    if image.dtype != np.uint8 or channels not in (1, 3):
        raise MediaError("only 8-bit grey and RGB are written")
    bits = 8 * channels
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1) if channels == 1 else np.zeros((0, 4), np.uint8)
    if channels == 1:
        palette[:, 3] = 0
    stride = (width * bits + 31) // 32 * 4
    lines = np.zeros((height, stride), dtype=np.uint8)
    lines[:, : width * channels] = image[::-1, :, ::-1].reshape(height, -1)
    start = 54 + palette.size
    head = struct.pack("<2sIHHI", b"BM", start + lines.size, 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, bits, 0, lines.size, 2835, 2835, len(palette), 0)
    return head + info + palette.tobytes() + lines.tobytes()


def read_image(data: bytes) -> np.ndarray:
    return read_bmp(data) if data[:2] == b"BM" else read_netpbm(data)


# Area resizing by integral images, tiles, hashes.


def integral(image: np.ndarray) -> np.ndarray:
    """Sums of all samples above and left of each corner."""
    out = np.zeros((image.shape[0] + 1, image.shape[1] + 1, image.shape[2]), dtype=np.float64)
    np.cumsum(image, axis=0, out=out[1:, 1:], dtype=np.float64)
    np.cumsum(out[1:, 1:], axis=1, out=out[1:, 1:])
    return out


def _at(table_: np.ndarray, axis: int, edges: np.ndarray) -> np.ndarray:
    """The integral at fractional edges along an axis: linear between corners, which is exact for a sum of constant pixels."""
    low = np.minimum(np.floor(edges).astype(np.int64), table_.shape[axis] - 2)
    share = (edges - low).reshape([-1 if i == axis else 1 for i in range(table_.ndim)])
    a, b = table_.take(low, axis), table_.take(low + 1, axis)
    return a + (b - a) * share


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over the areas that the target pixels cover, as float64."""
    sums = integral(image)
    ys, xs = np.arange(height + 1) * (image.shape[0] / height), np.arange(width + 1) * (image.shape[1] / width)
    corners = _at(_at(sums, 0, ys), 1, xs)
    area = (image.shape[0] / height) * (image.shape[1] / width)
    return (corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]) / area


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


def from_npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def tile_of(image: np.ndarray, side: int = TILE) -> np.ndarray:
    """The image as a square tile of 8-bit samples (16-bit ones are scaled)."""
    means = resize(image, side, side) / (257.0 if image.dtype == np.uint16 else 1.0)
    return np.clip(np.rint(means), 0, 255).astype(np.uint8)


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: is each cell of 8 x 9 brighter than its right neighbour? Channels are averaged."""
    cells = np.rint(resize(image.mean(axis=2, keepdims=True), 8, 9)[:, :, 0] * 4096)
    return np.packbits(cells[:, :-1] > cells[:, 1:]).tobytes().hex()


# Columns.


def _tile_rows(side: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string()]
        names = ["media_id", "height", "width", "channels", "tile", "dhash", "error"]
        for batch in batches:
            rows = []
            for i, data in zip(textvec.column(batch, "media_id").to_pylist(), textvec.column(batch, "media").to_pylist(), strict=True):
                try:
                    image = read_image(data or b"")
                    rows.append((i, *image.shape, npy(tile_of(image, side)), difference_hash(image), None))
                except MediaError as e:
                    rows.append((i, None, None, None, None, None, str(e)))
            cols = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return textvec.lean(run)


def tiles(media: DataFrame, side: int = TILE) -> DataFrame:
    """(media_id, height, width, channels, tile, dhash, error) of each row of ``media`` (media_id, media; others are ignored).

    Null or empty bytes, other formats and cut-off images give nulls and the
    reason in ``error``. Repeated rows give equal tiles. Empty tables give no rows.
    """
    schema = "media_id long, height int, width int, channels int, tile binary, dhash string, error string"
    return media.select("media_id", "media").mapInArrow(_tile_rows(side), schema)


def payload_of(text: str | None) -> tuple[int, bytes]:
    """The text's bytes in number, and padded to a positive multiple of a block."""
    raw = (text or "").encode()
    return len(raw), raw + FILL * ((-len(raw)) % BLOCK if raw else BLOCK)


def store(payload: bytes) -> bytes:
    """A payload as a grey image of WIDTH columns: BMP for an even number of blocks, else raw Netpbm."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH, 1)
    return write_bmp(image) if len(payload) // BLOCK % 2 == 0 else write_netpbm(image)


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "tile"]
    kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()]
    for whole in batches:
        for first in range(0, whole.num_rows, 1000):
            batch = whole.slice(first, 1000)
            rows = []
            for i, text in zip(textvec.column(batch, "doc_id").to_pylist(), textvec.column(batch, "text").to_pylist(), strict=True):
                n, payload = payload_of(text)
                media = store(payload)
                image = read_image(media)
                back = image.tobytes()
                # The tile goes through its own bytes too: what is returned is what a reader of the file gets.
                tile = npy(tile_of(image))
                feature = f"{difference_hash(image)}{zlib.crc32(from_npy(tile).tobytes()):08x}"
                rows.append((i, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature, tile))
            cols = list(zip(*rows, strict=True)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)


def store_texts(docs: DataFrame) -> DataFrame:
    """Each text of ``docs`` (doc_id, text; others are ignored) as a stored image, read back, with its features and tile.

    Null texts count as empty, which are one block of padding. Equal texts give
    equal values. Empty tables give no rows.
    """
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"
    return docs.selectExpr("cast(doc_id as long) as doc_id", "text").mapInArrow(textvec.lean(_text_rows), schema)


def op3_netpbm_bmp_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_texts(table(spark, sf_dir, "documents")).drop("tile")
