"""Media columns: Netpbm and BMP files in a binary column, decoded to numpy arrays and reduced to tiles.

``encode`` stores bytes as 8-bit samples of an image file, ``decode`` gives the samples of any file it knows,
``resize`` shrinks by exact area means out of an integral image, ``npy`` writes a tile in NumPy's own format and
``dhash`` is the difference hash of a tile. All of them are plain functions on one image; ``store`` and ``features``
run them over a table.
"""

from __future__ import annotations

import hashlib
import io
import math
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Payloads are padded to whole rows of this many samples, and to whole blocks of this many bytes.
WIDTH, BLOCK, PAD = 24, 576, 255
TILE = 16
PART_BYTES = 8 << 20  #: bytes of texts or files that are copied at a time
STRIP = 1 << 20  #: samples of a strip


def encode(payload: bytes) -> bytes:
    """A grey image of width 24 with these samples, their number a multiple of 576: PGM if that multiple is odd, else BMP."""
    height = len(payload) // WIDTH
    if len(payload) // BLOCK % 2:
        return b"P5\n%d %d\n255\n" % (WIDTH, height) + payload
    palette = b"".join(bytes((v, v, v, 0)) for v in range(256))
    start = 14 + 40 + len(palette)
    head = b"BM" + struct.pack("<IHHI", start + len(payload), 0, 0, start)
    # A negative height: rows go from top to bottom. The width is a multiple of four, so rows have no padding.
    info = struct.pack("<IiiHHIIiiII", 40, WIDTH, -height, 1, 8, 0, len(payload), 2835, 2835, 256, 0)
    return head + info + palette + payload


def decode(file: bytes) -> np.ndarray:
    """The samples as height x width (grey, bits) or height x width x 3 (colour). ValueError for anything else, whatever
    the bytes are."""
    if file[:2] in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        return _netpbm(file)
    if file[:2] == b"BM":
        return _bmp(file)
    raise ValueError("neither Netpbm nor BMP")


def _netpbm(file: bytes) -> np.ndarray:
    kind, at, fields = file[1:2], 2, []
    while len(fields) < (2 if kind in b"14" else 3):
        if at >= len(file):
            raise ValueError("header ends early")
        c = file[at : at + 1]
        if c == b"#":
            at = file.find(b"\n", at) + 1 or len(file)
        elif c.isspace():
            at += 1
        else:
            stop = at
            while stop < len(file) and file[stop : stop + 1].isdigit():
                stop += 1
            if stop == at:
                raise ValueError("no number in the header")
            fields.append(int(file[at:stop]))
            at = stop
    width, height, *most = fields
    most = most[0] if most else 1
    if not (width > 0 and height > 0 and 0 < most < 65536):
        raise ValueError("sizes out of range")
    shape = (height, width, 3) if kind in b"36" else (height, width)
    n = math.prod(shape)
    if kind == b"4":
        row = -(-width // 8)
        _holds(file, at + 1, row * height)
        packed = np.frombuffer(file, np.uint8, row * height, at + 1).reshape(height, row)
        return 1 - np.unpackbits(packed, axis=1)[:, :width]
    if kind in b"56":
        _holds(file, at + 1, n * (2 if most > 255 else 1))
        values = np.frombuffer(file, ">u2" if most > 255 else np.uint8, n, at + 1)
    else:
        rest = [b"%c" % b for b in file[at:] if b in b"01"] if kind == b"1" else file[at:].split()
        if len(rest) < n or not all(x.isdigit() and len(x) < 10 for x in rest[:n]):
            raise ValueError("samples are missing or no numbers")
        values = np.array(rest[:n]).astype(np.int64)
    if n and values.max() > most:
        raise ValueError("a sample is too large")
    if kind == b"1":
        values = 1 - values  # a set bit is black
    return values.reshape(shape).astype(np.uint16 if most > 255 else np.uint8)


def _holds(file: bytes, start: int, size: int) -> None:
    if start + size > len(file):
        raise ValueError("samples are missing")


def _bmp(file: bytes) -> np.ndarray:
    if len(file) < 54:
        raise ValueError("header ends early")
    start = struct.unpack_from("<I", file, 10)[0]
    size, width, height, _, bits, packing, _, _, _, colours, _ = struct.unpack_from("<IiiHHIIiiII", file, 14)
    if packing or bits not in (8, 24, 32) or width <= 0 or not height:
        raise ValueError("only plain BMP files of 8, 24 or 32 bits")
    row = -(-width * bits // 32) * 4
    _holds(file, start, row * abs(height))
    raw = np.frombuffer(file, np.uint8, row * abs(height), start).reshape(abs(height), row)
    raw = raw[:, : width * bits // 8].reshape(abs(height), width, bits // 8)
    raw = raw if height < 0 else raw[::-1]
    if bits > 8:
        return raw[:, :, 2::-1]
    _holds(file, 14 + size, 4 * (colours or 256))
    palette = np.frombuffer(file, np.uint8, 4 * (colours or 256), 14 + size).reshape(-1, 4)[:, 2::-1]
    if raw.max() >= len(palette):
        raise ValueError("a sample passes the palette")
    if (palette == palette[:, :1]).all():
        return palette[:, 0][raw[:, :, 0]]
    return palette[raw[:, :, 0]]


def resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over ``height x width`` equal boxes of the image; samples that a box cuts count by their share.

    The integral image is made of strips of rows, one after the other: of a strip only what it adds to each box is kept.
    """
    n_rows, n_columns = image.shape[:2]
    edges = np.linspace(0, n_rows, height + 1)
    across = np.linspace(0, n_columns, width + 1)
    low = np.minimum(across.astype(int), n_columns - 1)
    part = (across - low).reshape(-1, *[1] * (image.ndim - 2))
    boxes = np.zeros((height, width, *image.shape[2:]))
    step = max(1, STRIP // max(1, n_columns * math.prod(image.shape[2:])))
    for top in range(0, n_rows, step):
        strip = image[top : top + step]
        sums = np.zeros((len(strip) + 1, n_columns + 1, *image.shape[2:]))
        np.cumsum(strip, axis=0, dtype=np.float64, out=sums[1:, 1:])
        np.cumsum(sums[1:, 1:], axis=1, out=sums[1:, 1:])
        columns = np.diff(np.take(sums, low, 1) * (1 - part) + np.take(sums, low + 1, 1) * part, axis=1)
        place = np.clip(edges - top, 0, len(strip))
        row = np.minimum(place.astype(int), len(strip) - 1)
        share = (place - row).reshape(-1, *[1] * (image.ndim - 1))
        boxes += np.diff(columns[row] * (1 - share) + columns[row + 1] * share, axis=0)
    return boxes * (height * width / (n_rows * n_columns))


def grey(image: np.ndarray) -> np.ndarray:
    return image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])


def npy(tile: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, tile, allow_pickle=False)
    return out.getvalue()


def dhash(image: np.ndarray) -> str:
    """64 bits: whether each of 8 x 8 area means is below its right neighbour, in hexadecimal."""
    small = np.rint(resize(grey(image), 8, 9) * 256)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def store(docs: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Replace ``text`` by ``n_bytes`` and the binary column ``media``, an image file that holds the UTF-8 text.

    Null is empty; byte 255, which no UTF-8 text has, fills up to a positive multiple of 576. A map over rows.
    """
    rest = [c for c in docs.columns if c not in (text, media, "n_bytes")]
    source = docs.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{text}`").cast("binary").alias("__body"))
    schema = T.StructType([*(source.schema[c] for c in rest), T.StructField("n_bytes", T.LongType()), T.StructField(media, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _bounded(batches, "__body"):
            bodies = [x or b"" for x in part["__body"].to_pylist()]
            files = [encode(b.ljust(max(1, -(-len(b) // BLOCK)) * BLOCK, bytes([PAD]))) for b in bodies]
            made = [pa.array([len(b) for b in bodies], pa.int64()), pa.array(files, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(rest))), *made], [*rest, "n_bytes", media])

    return source.mapInArrow(run, schema)


MADE = T.StructType(
    [
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("tail_crc32", T.LongType()),
        T.StructField("media_bytes", T.LongType()),
        T.StructField("media_sha256", T.StringType()),
        T.StructField("feature", T.StringType()),
        T.StructField("tile", T.BinaryType()),
    ]
)


def features(rows: DataFrame, media: str = "media") -> DataFrame:
    """Replace ``media`` by what its decoded samples give; ``tile`` is a 16 x 16 area mean as float32 NPY file and
    ``feature`` its difference hash.

    A null file, or one that can't be decoded, gives null in all of the new columns but ``media_bytes`` and
    ``media_sha256`` (null for null). Columns named like a result are replaced. A map over rows.
    """
    rest = [c for c in rows.columns if c != media and c not in MADE.names]
    source = rows.select(*(F.col(f"`{c}`") for c in rest), F.col(f"`{media}`").alias("__media"))
    schema = T.StructType([*(source.schema[c] for c in rest), *MADE.fields])

    def one(file: bytes | None) -> tuple:
        if file is None:
            return (None,) * 7
        stored = (len(file), hashlib.sha256(file).hexdigest())
        try:
            image = decode(file)
        except ValueError:
            return (None, None, None, *stored, None, None)
        payload = image.tobytes()
        tile = resize(grey(image), TILE, TILE).astype(np.float32)
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *stored, dhash(tile), npy(tile))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _bounded(batches, "__media"):
            made = zip(*map(one, part["__media"].to_pylist()), strict=True)
            columns = [pa.array(x, t) for x, t in zip(made, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(rest))), *columns], schema.names)

    return source.mapInArrow(run, schema)


def _bounded(batches: Iterator[pa.RecordBatch], column: str, rows: int = 512, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts of few rows and bytes of ``column``, so that copies of them stay small; a longer value is a part of its own."""
    for batch in batches:
        lengths = pc.binary_length(batch[column]).fill_null(0).to_numpy()
        at = held = 0
        for k, n in enumerate(lengths.tolist()):
            if k > at and (k - at == rows or held + n > size):
                yield batch.slice(at, k - at)
                at, held = k, 0
            held += n
        if at < batch.num_rows:
            yield batch.slice(at)
