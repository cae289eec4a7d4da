"""Media columns: lossless PNG images in a binary column, read back with checksum tests, and perceptual hashes of them.

Bytes become the grey samples of an 8-bit PNG: signature, IHDR, IDAT (zlib) and IEND chunks, each with its CRC. Every row
is stored by that of the five row filters whose differences are least in sum. The width is that of ``WIDTHS``, all of them
divisors of a block, which makes the image most nearly square, so that it depends on the number of bytes alone.

Reading tests the signature and every chunk's CRC and length, inflates, and undoes the filters with numpy: a sample needs
those to the left of it, above it and between the two, so all samples of one diagonal are undone at once, over all images
of a width that came in one batch. The feature is a cosine-transform hash: the image is averaged down to 32 x 32,
transformed, and the signs of its 8 x 8 lowest frequencies against their median, the constant term left out, make 64 bits.

Defined results: a null or empty text is stored as one block of padding; equal bytes give equal images and features;
ties of filters go to the lower number, ties with the median give bit 0; repeated rows give repeated results; a null
doc_id stays null; extra columns are ignored. A damaged image raises ``ValueError``.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from spectraloom.llm.common import pieces, table

SIGNATURE = b"\x89PNG\r\n\x1a\n"
BLOCK = 576
WIDTHS = (24, 48, 96, 192, 576)
PAD = b"\xff"
LEVEL = 6
SIDE, LOW = 32, 8
FILTERS = 5
FEW_VALUES = 128  # samples of fewer values are like indexed colours, which the format's authors advise not to filter


def pad(payload: bytes, block: int = BLOCK) -> bytes:
    """``payload`` filled up with bytes 255 to a positive multiple of ``block``."""
    return payload + PAD * (max(block, -(-len(payload) // block) * block) - len(payload))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def width_for(payload_bytes: int) -> int:
    """The width that makes an image of so many bytes most nearly square."""
    fits = [w for w in WIDTHS if payload_bytes % w == 0]
    return min(fits, key=lambda w: (max(w, payload_bytes // w) / min(w, payload_bytes // w), w))


def _guesses(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> Iterator[np.ndarray | int]:
    """What each filter expects of a sample, from those to its left, above it and between them (signed 16 bits)."""
    yield 0
    yield a
    yield b
    yield (a + b) >> 1
    da, db = np.abs(b - c), np.abs(a - c)
    dc = np.abs(a + b - c - c)
    yield np.where((da <= db) & (da <= dc), a, np.where(db <= dc, b, c))


def filter_rows(samples: np.ndarray, kind: int | None = None) -> np.ndarray:
    """Rows led by their filter type: ``kind``, or for each row the one whose signed differences are least in sum."""
    height, width = samples.shape
    if kind == 0:
        return np.concatenate([np.zeros((height, 1), np.uint8), samples], axis=1)
    around = np.zeros((height + 1, width + 1), np.int16)
    around[1:, 1:] = samples
    out, least = np.empty((height, width + 1), np.uint8), np.full(height, np.iinfo(np.int64).max)
    for k, guess in enumerate(_guesses(around[1:, :-1], around[:-1, 1:], around[:-1, :-1])):
        if kind not in (None, k):
            continue
        rest = (around[1:, 1:] - guess).astype(np.uint8)
        cost = np.abs(rest.view(np.int8).astype(np.int16)).sum(axis=1, dtype=np.int64)
        better = cost < least
        least[better] = cost[better]
        out[better, 0], out[better, 1:] = k, rest[better]
    return out


def filter_for(samples: np.ndarray) -> int | None:
    """0, no filter, for samples of few values, as in text, or where every third row deflates to no more bytes so; else None."""
    if np.count_nonzero(np.bincount(samples.ravel(), minlength=256)) < FEW_VALUES:
        return 0
    some = samples[::3]
    size = lambda kind: len(zlib.compress(filter_rows(some, kind).tobytes(), 1))
    return 0 if size(0) <= size(None) else None


def encode_png(samples: np.ndarray, kind: int | None = None) -> bytes:
    """A grey 8-bit PNG of a (height, width) array; rows are filtered by ``kind``, or each as it suits it where that pays."""
    height, width = samples.shape
    kind = filter_for(samples) if kind is None else kind
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(filter_rows(samples, kind).tobytes(), LEVEL)) + _chunk(b"IEND", b"")


def _chunks(media: bytes) -> Iterator[tuple[bytes, bytes]]:
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at = 8
    while at < len(media):
        if at + 12 > len(media):
            raise ValueError("a chunk is cut off")
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        body = media[at + 8 : at + 8 + n]
        if len(body) < n or at + 12 + n > len(media) or struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise ValueError(f"chunk {kind!r} fails its checksum")
        yield kind, body
        at += 12 + n


def _summed(rows: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Samples of rows of the filters 0 to 2: sums along a row, and sums down from the last row that doesn't look up; modulo 256."""
    kind, out = rows[:, 0], rows[:, 1:].copy()
    left = kind == 1
    if left.any():
        out[left] = np.cumsum(out[left], axis=1, dtype=np.uint8)
    up = (kind == 2) & (place > 0)
    if up.any():
        down = np.zeros((len(rows) + 1, out.shape[1]), np.uint8)
        np.cumsum(out, axis=0, dtype=np.uint8, out=down[1:])
        start = np.maximum.accumulate(np.where(up, 0, np.arange(len(rows))))
        out = down[1:] - down[start]
    return out


def unfilter(rows: np.ndarray, place: np.ndarray | None = None) -> np.ndarray:
    """The samples of filtered rows, each led by its filter type; one byte a sample.

    ``place`` is each row's number in its image where images of one width follow each other; without it all are one image.
    Filters that look only left or only up are undone by running sums; where others are met too, samples are undone diagonal
    by diagonal, of all images at once.
    """
    height, width = len(rows), rows.shape[1] - 1
    place = np.arange(height) if place is None else place
    if (rows[:, 0] > 4).any():
        raise ValueError("unknown filter type")
    if (rows[:, 0] <= 2).all():
        return _summed(rows, place)
    stride = width + 1
    out = np.zeros((height + 1) * stride, np.int16)  # a zero leads each row, and the first row is zeros: what lies outside
    order = np.argsort(place, kind="stable")
    y, kind = place[order], rows[order, 0]
    here = (order + 1) * stride
    above = np.where(y > 0, here - stride, 0)
    rest = rows.ravel()
    lo, hi = np.searchsorted(y, np.arange(y[-1] + width) - width + 1), np.searchsorted(y, np.arange(y[-1] + width), side="right")
    for t, (i, j) in enumerate(zip(lo.tolist(), hi.tolist())):
        x = t - y[i:j] + 1
        at = here[i:j] + x
        up = above[i:j] + x
        guess = np.choose(kind[i:j], list(_guesses(out[at - 1], out[up], out[up - 1])))
        out[at] = (rest[at - stride] + guess) & 255
    return out.reshape(height + 1, stride)[1:, 1:].astype(np.uint8)


def _inflate(media: bytes) -> np.ndarray:
    """The filtered rows of a grey 8-bit PNG, after all its checksums hold."""
    parts = list(_chunks(media))
    if not parts or parts[0][0] != b"IHDR" or parts[-1][0] != b"IEND":
        raise ValueError("a PNG begins with IHDR and ends with IEND")
    width, height, depth, colour, packing, filtering, interlace = struct.unpack(">IIBBBBB", parts[0][1])
    if (depth, colour, packing, filtering, interlace) != (8, 0, 0, 0, 0):
        raise ValueError("only grey 8-bit images without interlacing are stored here")
    raw = zlib.decompress(b"".join(body for kind, body in parts if kind == b"IDAT"))
    if len(raw) != height * (width + 1):
        raise ValueError("the image data have another length than its head says")
    return np.frombuffer(raw, np.uint8).reshape(height, width + 1)


def decode_pngs(images: list[bytes]) -> list[np.ndarray]:
    """The (height, width) samples of each image."""
    rows = [_inflate(m) for m in images]
    out: list[np.ndarray] = [np.empty(0)] * len(rows)
    for width in {r.shape[1] for r in rows}:
        same = [i for i, r in enumerate(rows) if r.shape[1] == width]
        heights = [len(rows[i]) for i in same]
        samples = unfilter(np.concatenate([rows[i] for i in same]), np.concatenate([np.arange(h) for h in heights]))
        for i, part in zip(same, np.split(samples, np.cumsum(heights)[:-1])):
            out[i] = part
    return out


def decode_png(media: bytes) -> np.ndarray:
    return decode_pngs([media])[0]


@cache
def _cosines(n: int = SIDE, low: int = LOW) -> np.ndarray:
    return np.cos(np.pi * np.arange(low)[:, None] * (2 * np.arange(n)[None, :] + 1) / (2 * n))


def _shrunk(a: np.ndarray, n: int = SIDE) -> np.ndarray:
    """Row bands averaged to n rows; fewer rows than n are repeated."""
    if len(a) < n:
        return a[np.arange(n) * len(a) // n]
    edges = np.arange(n + 1) * len(a) // n
    return np.add.reduceat(a, edges[:-1], axis=0) / np.diff(edges)[:, None]


def cosine_hash(samples: np.ndarray) -> str:
    """64 bits as 16 hexadecimal digits."""
    small = _shrunk(_shrunk(samples.astype(np.float64)).T).T
    low = np.round(_cosines() @ small @ _cosines().T, 6).ravel()
    bits = low > np.median(low[1:])
    bits[0] = False
    return np.packbits(bits).tobytes().hex()


def _image(payload: bytes) -> bytes:
    return encode_png(np.frombuffer(payload, np.uint8).reshape(-1, width_for(len(payload))))


def _store(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        held = [b.as_py() for b in batch.column("text").fill_null("").cast(pa.binary())]
        media = [_image(pad(b)) for b in held]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, held), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    for batch in pieces(batches, "media"):
        held, out = [m.as_py() for m in batch.column("media")], []
        for media, samples in zip(held, decode_pngs(held)):
            payload = samples.tobytes()
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), cosine_hash(samples)))
        columns = [pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, types)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], ["doc_id", "n_bytes", *names])


def store_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the binary column ``media``: each text's bytes as a PNG image."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_store, f"doc_id {kind}, n_bytes long, media binary")


def media_features(stored: DataFrame) -> DataFrame:
    """Digests and the feature of each image of the column ``media``, worked out from the stored bytes."""
    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.select("doc_id", "n_bytes", "media").mapInArrow(_read, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(store_media(table(spark, sf_dir, "documents")))
