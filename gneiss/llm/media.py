"""Media columns: Netpbm and BMP to numpy arrays, area resize by integral images, NPY tiles, difference hashes."""

from __future__ import annotations

import io
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: A tile's side, and the bits of a difference hash per side.
TILE, HASH_SIDE = 16, 8


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 to an array of height x width (gray) or height x width x 3, uint8 or uint16."""
    kind = data[:2]
    need, fields, at = (2 if kind in (b"P1", b"P4") else 3), [], 2
    while len(fields) < need:
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    width, height, most = fields[0], fields[1], fields[2] if need == 3 else 1
    bands = 3 if kind in (b"P3", b"P6") else 1
    shape = (height, width, 3) if bands == 3 else (height, width)
    if kind in (b"P1", b"P2", b"P3"):
        body = data[at:].translate(None, b" \t\r\n") if kind == b"P1" else data[at:].split()
        values = np.frombuffer(body, np.uint8) - 48 if kind == b"P1" else np.array(body, dtype=np.int64)
        out = values[: height * width * bands].astype(np.uint16 if most > 255 else np.uint8).reshape(shape)
    elif kind == b"P4":
        row = (width + 7) // 8
        bits = np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row)
        out = np.unpackbits(bits, axis=1)[:, :width]
    else:
        dtype = np.dtype(">u2") if most > 255 else np.dtype(np.uint8)
        out = np.frombuffer(data, dtype, height * width * bands, at + 1).reshape(shape).astype(dtype.newbyteorder("="))
    return 1 - out if kind in (b"P1", b"P4") else out


def encode_pgm(pixels: np.ndarray) -> bytes:
    """A gray uint8 array as binary PGM."""
    return b"P5\n%d %d\n255\n" % (pixels.shape[1], pixels.shape[0]) + pixels.tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 (gray or palette), 16, 24 or 32 bits, also with bit masks, to an array of height x width (x 3, RGB). Others (1 or 4 bits, run lengths) raise ValueError."""
    (start,), (width, height, _, bits, packed) = struct.unpack_from("<I", data, 10), struct.unpack_from("<iiHHI", data, 18)
    if packed not in (0, 3) or bits not in (8, 16, 24, 32) or packed == 3 and bits not in (16, 32):
        raise ValueError(f"BMP with {bits} bits and compression {packed}")
    row = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, row * abs(height), start).reshape(abs(height), row)
    rows = rows[::-1] if height > 0 else rows
    if bits == 16 or packed == 3:
        # masks stand behind the first 40 bytes of the header; without them 16 bits are 5 a colour
        masks = struct.unpack_from("<III", data, 54) if packed == 3 else (0x7C00, 0x3E0, 0x1F)
        values = rows[:, : width * bits // 8].copy().view("<u2" if bits == 16 else "<u4").astype(np.int64)
        low = [(m & -m).bit_length() - 1 for m in masks]
        return np.stack([((values & m) >> s) * 255 // max(1, m >> s) for m, s in zip(masks, (max(0, s) for s in low))], axis=2).astype(np.uint8)
    if bits > 8:
        return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1].copy()
    header = struct.unpack_from("<I", data, 14)[0]
    palette = np.frombuffer(data, np.uint8, start - 14 - header, 14 + header).reshape(-1, 4)[:, 2::-1]
    out = palette[rows[:, :width]]
    return out[:, :, 0].copy() if (out[:, :, :1] == out).all() else out


def decode(data: bytes) -> np.ndarray:
    """Netpbm or BMP, told by the first bytes."""
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def area_resize(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target cell's area, from an integral image; cells may cut pixels. Returns float64."""
    gray = pixels.mean(axis=2) if pixels.ndim == 3 else pixels
    h, w = gray.shape
    total = np.zeros((h + 1, w + 1))
    np.cumsum(np.cumsum(gray, axis=0, dtype=np.float64), axis=1, out=total[1:, 1:])

    def between(edges: np.ndarray, along: np.ndarray) -> np.ndarray:
        low = np.minimum(edges.astype(int), along.shape[0] - 2)
        part = (edges - low)[:, None]
        return along[low] * (1 - part) + along[low + 1] * part

    at_rows = between(np.linspace(0, h, height + 1), total)
    corners = between(np.linspace(0, w, width + 1), at_rows.T).T
    return (corners[1:, 1:] - corners[:-1, 1:] - corners[1:, :-1] + corners[:-1, :-1]) * (height * width / (h * w))


def difference_hash(pixels: np.ndarray, side: int = HASH_SIDE) -> str:
    """side x side bits, as hex: is each cell darker than its right neighbour."""
    small = np.round(area_resize(pixels, side, side + 1), 6)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy_tile(pixels: np.ndarray, side: int = TILE) -> bytes:
    """The image resized to side x side samples of its own type (8 or 16 bits), as an NPY file."""
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(pixels, side, side)), 0, np.iinfo(pixels.dtype).max).astype(pixels.dtype), allow_pickle=False)
    return out.getvalue()


TILED = {"width": pa.int32(), "height": pa.int32(), "pixels": pa.binary(), "tile": pa.binary(), "dhash": pa.string(), "error": pa.string()}
SLICE = 500


def tiles(media: DataFrame, side: int = TILE) -> DataFrame:
    """media with width, height, decoded pixels, NPY tile and difference hash of each row's `media`.

    A null, empty or broken file gives a row with `error` set and the other new columns null; columns of the new
    names are replaced. Rows are handled one by one, so copies and ties cost and return the same.
    """
    media = media.drop(*TILED)
    added = [T.StructField(k, {pa.int32(): T.IntegerType(), pa.binary(): T.BinaryType(), pa.string(): T.StringType()}[v]) for k, v in TILED.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # small slices: one batch may hold very large media
            for low in range(0, batch.num_rows, SLICE):
                part, rows = batch.slice(low, SLICE), []
                for data in part.column("media"):
                    try:
                        pixels = decode(data.as_py() or b"")
                        rows.append((pixels.shape[1], pixels.shape[0], pixels.tobytes(), npy_tile(pixels, side), difference_hash(pixels), None))
                    except Exception as e:  # noqa: BLE001  a broken file is a row, not a failed job
                        rows.append((None, None, None, None, None, f"{type(e).__name__}: {e}"[:200]))
                new = [pa.array(c, kind) for c, kind in zip(zip(*rows), TILED.values())]
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *TILED])

    return media.mapInArrow(run, T.StructType([*media.schema.fields, *added]))


def as_media(docs: DataFrame, unit: int = 576, width: int = 24) -> DataFrame:
    """Each text's UTF-8 bytes, with bytes 255 up to a positive multiple of `unit`, as a PGM of `width`: media_id, n_bytes, media."""
    schema = T.StructType([T.StructField("media_id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [x.as_py() or b"" for x in batch.column("text").cast(pa.binary())]
            media = [encode_pgm(np.frombuffer(r + b"\xff" * (-len(r) % unit if r else unit), np.uint8).reshape(-1, width)) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(r) for r in raw], pa.int64()), pa.array(media, pa.binary())], names=["media_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, schema)
