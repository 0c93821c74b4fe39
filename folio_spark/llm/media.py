"""Media columns: Netpbm and BMP bytes decoded to arrays, resized by area, written as NPY tiles with difference hashes.

A media column is a binary column. `decode` reads PGM, PPM, PBM and BMP (uncompressed, 8 or 24 bits) into uint8 arrays;
`resize_area` averages over fractional source areas through the integral image, of which only the rows at the targets' edges
are kept; `npy_bytes`/`npy_array` store an array
as an NPY tile and read it back; `difference_hash` compares neighbours of a 9 x 8 reduction.

Texts are media too: `payload` pads UTF-8 bytes with zeros to rows of 64 samples, so that any text is a grey image of
width 64, held losslessly.

Defined cases: null text is empty and becomes one row of zeros; bytes that are no image, or of a kind not read here,
decode to None and give null columns, as do images without samples, truncated ones, and samples over the maximum that the
header names; equal input gives equal output; a very long text is a single tall image, of which a task holds the text, the
stored form and BAND rows of sums. Only the named columns are read.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WIDTH = 64
#: Source rows that are summed at once.
BAND = 4096
_HEADER = re.compile(rb"(P[1-6])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)(?:(?:\s|#[^\n]*\n)+(\d+))?\s")
_BITMAP_HEADER = re.compile(rb"(P[14])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)\s")


def pgm_bytes(samples: np.ndarray) -> bytes:
    """A grey image (rows, columns) as binary PGM."""
    return b"P5\n%d %d\n255\n" % (samples.shape[1], samples.shape[0]) + samples.tobytes()


def _netpbm(data: bytes) -> np.ndarray | None:
    head = (_BITMAP_HEADER if data[:2] in (b"P1", b"P4") else _HEADER).match(data)
    if not head:
        return None
    kind, width, height = head[1], int(head[2]), int(head[3])
    if not width or not height or width * height > 8 * len(data):
        return None
    body = data[head.end() :]
    if kind == b"P4":
        row = -(-width // 8)
        if len(body) < row * height:
            return None
        bits = np.unpackbits(np.frombuffer(body, np.uint8, row * height).reshape(height, row), axis=1)
        return (1 - bits[:, :width]) * np.uint8(255)
    if kind == b"P1":
        bits = np.array([c == 49 for c in body if c in b"01"], np.uint8)
        return (1 - bits[: width * height].reshape(height, width)) * np.uint8(255) if len(bits) >= width * height else None
    depth, top = (3 if kind in (b"P3", b"P6") else 1), int(head[4] or 0)
    n = width * height * depth
    if not 0 < top < 65536:
        return None
    if kind in (b"P2", b"P3"):
        plain = np.array([int(x) for x in body.split()[:n]], dtype=np.int64)
    else:
        wide = np.dtype(">u2" if top > 255 else np.uint8)
        if len(body) < n * wide.itemsize:
            return None
        plain = np.frombuffer(body, wide, n)
    if len(plain) < n or plain.min() < 0 or plain.max() > top:
        return None
    if top != 255:
        plain = (plain.astype(np.int64) * 255 + top // 2) // top
    plain = plain.astype(np.uint8)
    return plain.reshape(height, width, 3) if depth == 3 else plain.reshape(height, width)


def _bmp(data: bytes) -> np.ndarray | None:
    if len(data) < 54:
        return None
    start, head, width, height, _, bits, packed = struct.unpack_from("<4xIIiiHHI", data, 6)
    if head < 40 or packed or bits not in (8, 24) or width <= 0 or not height:
        return None
    rows, step = abs(height), (width * bits // 8 + 3) // 4 * 4
    if len(data) < start + rows * step:
        return None
    body = np.frombuffer(data, np.uint8, rows * step, start).reshape(rows, step)[:: -1 if height > 0 else 1]
    if bits == 24:
        return body[:, : width * 3].reshape(rows, width, 3)[:, :, ::-1].copy()
    colours = np.frombuffer(data[14 + head : start], np.uint8)
    colours = colours[: len(colours) // 4 * 4].reshape(-1, 4)[:, 2::-1]
    index = body[:, :width]
    if not len(colours):
        return index.copy()
    return colours[index] if index.max() < len(colours) else None


def decode(data: bytes | None) -> np.ndarray | None:
    """(rows, columns) grey or (rows, columns, 3) colour samples; None where data is no image that is read here."""
    if not data:
        return None
    try:
        return _bmp(data) if data[:2] == b"BM" else _netpbm(data)
    except (ValueError, OverflowError, struct.error):
        return None


def _sums(image: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The integral of image along axis 0 up to fractional places `at`, ascending."""
    out, total, done = np.empty((len(at), *image.shape[1:])), np.zeros(image.shape[1:]), 0
    for k, place in enumerate(at):
        low = min(int(place), len(image) - 1)
        for a in range(done, low, BAND):
            total += image[a : min(a + BAND, low)].sum(axis=0, dtype=np.float64)
        done = low
        out[k] = total + (place - low) * image[low]
    return out


def resize_area(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Each target sample is the mean over its own rectangle of the source, from differences of the integral image."""
    rows = _sums(image, np.linspace(0, image.shape[0], height + 1))
    both = _sums(np.swapaxes(rows, 0, 1), np.linspace(0, image.shape[1], width + 1))
    total = np.diff(np.diff(np.swapaxes(both, 0, 1), axis=0), axis=1)
    return total * (height * width / (image.shape[0] * image.shape[1]))


def difference_hash(image: np.ndarray) -> str:
    """64 bits in hex: whether each sample of the 9 x 8 reduction is darker than its right neighbour.

    Differences under a thousandth of a level count as none, so that rounding of sums does not decide a bit.
    """
    small = resize_area(image, 8, 9)
    small = small.mean(axis=2) if image.ndim == 3 else small
    return np.packbits(np.diff(small, axis=1) > 1e-3).tobytes().hex()


def npy_bytes(image: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(image), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def npy_array(data: bytes) -> np.ndarray:
    return np.lib.format.read_array(io.BytesIO(data), allow_pickle=False)


def payload(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDTH if text else WIDTH)


def tiles(df: DataFrame, column: str, height: int, width: int) -> DataFrame:
    """Media bytes in `column` to `tile` (NPY of the area-resized array, uint8) and `dhash`; other columns are kept.

    A column of df called tile or dhash is replaced.
    """
    kept = [f for f in df.schema.fields if f.name not in ("tile", "dhash")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                images = [decode(x) for x in batch.column(column).to_pylist()]
                stored = [None if x is None else npy_bytes(np.rint(resize_area(x, height, width)).astype(np.uint8)) for x in images]
                hashes = [None if x is None else difference_hash(x) for x in images]
                cols = {f.name: batch.column(f.name) for f in kept} | {"tile": pa.array(stored, pa.binary()), "dhash": pa.array(hashes, pa.string())}
                yield pa.RecordBatch.from_pydict(cols)

    shape = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return df.mapInArrow(run, f"{shape}, tile binary, dhash string")


def text_tiles(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with each text as a grey image: `media`, its NPY tile of full size, and `dhash`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _slices(batches):
            images = [decode(pgm_bytes(np.frombuffer(payload(t), np.uint8).reshape(-1, WIDTH))) for t in texts]
            cols = [part.column(0), pa.array([npy_bytes(x) for x in images], pa.binary()), pa.array([difference_hash(x) for x in images])]
            yield pa.record_batch(cols, ["doc_id", "media", "dhash"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, media binary, dhash string")


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            yield part, [x or b"" for x in part.column(1).cast(pa.large_binary()).to_pylist()]


def text_media_facts(docs: DataFrame) -> DataFrame:
    """Per document of docs (doc_id, text): sizes and digests of the stored tile and of the payload read back from it.

    Text to payload, PGM image, decoded array, NPY tile; the tile's bytes are read back and all facts come from those.
    """

    def facts(text: bytes) -> tuple:
        image = decode(pgm_bytes(np.frombuffer(payload(text), np.uint8).reshape(-1, WIDTH)))
        media = npy_bytes(image)
        back = npy_array(media)
        data = back.tobytes()
        return (
            len(text),
            len(data),
            hashlib.sha256(data).hexdigest(),
            zlib.crc32(data[-WIDTH:]),
            len(media),
            hashlib.sha256(media).hexdigest(),
            difference_hash(back),
        )

    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _slices(batches):
            rows = list(zip(*map(facts, texts), strict=True))
            yield pa.record_batch([part.column(0), *[pa.array(x, k) for x, k in zip(rows, kinds, strict=True)]], ["doc_id", *names])

    kind = docs.schema["doc_id"].dataType.simpleString()
    spark_kinds = {pa.int64(): "long", pa.string(): "string"}
    shape = ", ".join(f"{n} {spark_kinds[k]}" for n, k in zip(names, kinds, strict=True))
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {shape}")
