"""Media columns: AVI files with intra-coded (motion) JPEG frames, and their shots.

The frames written here are greyscale lossless JPEG (predictive process, SOF3): each sample is predicted by its left
neighbour, and the first of a row by the one above. The Huffman table gives category k a code of 9 - k bits, so a code
and its k extra bits always take 9 bits: frames of equal size are written and read as whole arrays. Frames of others are
read by jpeg.decode(): baseline motion JPEG, and lossless frames of any table.

Shots begin where the histogram of a frame's luminance changes more than is usual in the frames before it.

Edge cases: a null text is an empty one; the payload of an empty text is one block of spaces; equal texts give equal
values; a very long text is written and read in runs of RUN frames; a clip with one frame has one shot; repeated rows
give equal rows; an empty table gives an empty result; other columns may have any name and are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from braidwork.llm import jpeg
from braidwork.llm.blocks import slices

#: Samples of a frame.
WIDTH, HEIGHT = 16, 12
FRAME = WIDTH * HEIGHT
MICROSECONDS = 40_000
BITS = 9
#: Frames that are coded at once.
RUN = 2048
#: Histogram bins of a frame; frames looked back at, and standard deviations, for the adaptive cut threshold.
BINS, BACK, DEVIATIONS = 16, 8, 3.0

_INDEX = np.dtype([("id", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")])


def _segment(marker: int, body: bytes) -> bytes:
    return bytes([0xFF, marker]) + (len(body) + 2).to_bytes(2, "big") + body


def jpeg_head(width: int, height: int) -> bytes:
    """Everything of a frame before its entropy-coded samples."""
    # One code of each length 1..9, for the categories 8..0.
    table = bytes([0x00] + [1] * BITS + [0] * (16 - BITS) + list(range(BITS - 1, -1, -1)))
    frame = bytes([8]) + height.to_bytes(2, "big") + width.to_bytes(2, "big") + bytes([1, 1, 0x11, 0])
    return b"\xff\xd8" + _segment(0xC4, table) + _segment(0xC3, frame) + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))


_HEAD = jpeg_head(WIDTH, HEIGHT)


def _coder() -> tuple[np.ndarray, np.ndarray]:
    """9-bit word of each difference -255..255 (at + 255), and the difference of each 9-bit word."""
    word, value = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        k = abs(d).bit_length()
        ones = 8 - k  # code of category k: that many ones, then a zero, in 9 - k bits
        code = ((1 << ones) - 1) << 1
        extra = d if d >= 0 else d + (1 << k) - 1
        word[d + 255] = code << k | extra
        value[word[d + 255]] = d
    return word, value


_WORD, _VALUE = _coder()


def encode_frames(payload: np.ndarray) -> list[bytes]:
    """Entropy-coded samples of each frame of 192 bytes, with stuffed zero bytes after 0xFF."""
    out = []
    for k in range(0, len(payload), RUN * FRAME):
        x = payload[k : k + RUN * FRAME].reshape(-1, HEIGHT, WIDTH).astype(np.int16)
        d = x.copy()
        d[:, :, 1:] -= x[:, :, :-1]
        d[:, 1:, 0] -= x[:, :-1, 0]
        d[:, 0, 0] -= 128
        w = _WORD[d.reshape(-1, FRAME) + 255]
        bits = (w[:, :, None] >> np.arange(BITS - 1, -1, -1, dtype=np.uint16)).astype(np.uint8) & 1
        coded = np.packbits(bits.reshape(len(w), FRAME * BITS), axis=1)
        out += [row.tobytes().replace(b"\xff", b"\xff\x00") for row in coded]
    return out


def decode_frames(coded: list[bytes]) -> np.ndarray:
    """Samples of frames written by encode_frames."""
    out = np.empty((len(coded), HEIGHT, WIDTH), np.uint8)
    for k in range(0, len(coded), RUN):
        run = [c.replace(b"\xff\x00", b"\xff") for c in coded[k : k + RUN]]
        raw = np.frombuffer(b"".join(run), np.uint8).reshape(len(run), FRAME * BITS // 8)
        bits = np.unpackbits(raw, axis=1).reshape(len(run), FRAME, BITS)
        w = np.zeros(bits.shape[:2], np.uint16)
        for b in range(BITS):
            w = w << 1 | bits[:, :, b]
        d = _VALUE[w].reshape(-1, HEIGHT, WIDTH).astype(np.int32)
        d[:, 0, 0] += 128
        d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
        out[k : k + RUN] = np.cumsum(d, axis=2)
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + len(body).to_bytes(4, "little") + body + b"\0" * (len(body) % 2)


def _numbers(*values: int) -> bytes:
    return b"".join(v.to_bytes(4, "little") for v in values)


def write_avi(payload: np.ndarray) -> bytes:
    """An AVI file whose frames hold the payload, a multiple of 192 bytes."""
    frames = [_HEAD + c + b"\xff\xd9" for c in encode_frames(payload)]
    n = len(frames)
    parts, at = [], 4
    index = np.zeros(n, _INDEX)
    index["id"], index["flags"] = b"00dc", 0x10
    sizes = np.array([len(f) for f in frames], np.int64)
    steps = 8 + sizes + sizes % 2
    index["at"] = at + np.cumsum(steps) - steps
    index["size"] = sizes
    for f in frames:
        parts.append(b"00dc" + len(f).to_bytes(4, "little") + f + b"\0" * (len(f) % 2))
    main = _numbers(MICROSECONDS, 0, 0, 0x10, n, 0, 1, int(sizes.max()), WIDTH, HEIGHT, 0, 0, 0, 0)
    stream = b"vidsMJPG" + _numbers(0, 0, 0, MICROSECONDS, 1_000_000, 0, n, int(sizes.max()), 0xFFFFFFFF, 0) + b"\0" * 8
    form = _numbers(40, WIDTH, HEIGHT) + (1).to_bytes(2, "little") + (8).to_bytes(2, "little") + b"MJPG" + _numbers(FRAME, 0, 0, 0, 0)
    streams = _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form))
    head = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + streams)
    return _chunk(b"RIFF", b"AVI " + head + _chunk(b"LIST", b"movi" + b"".join(parts)) + _chunk(b"idx1", index.tobytes()))


def riff_chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, start and end of the body of each chunk."""
    while at + 8 <= end:
        size = int.from_bytes(data[at + 4 : at + 8], "little")
        yield data[at : at + 4], at + 8, at + 8 + size
        at += 8 + size + size % 2


def read_avi(data: bytes) -> tuple[int, list[bytes]]:
    """Microseconds a frame (those of write_avi where the file names none), and the video frames that the index lists,
    or, without an index, those of the movie list in order. Places in an index count from the movie list or from the
    start of the file. What lies beyond the end of the file is left out of a frame."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movie, end_of_movie, index, step = 0, 0, np.zeros(0, _INDEX), 0
    for name, start, end in riff_chunks(data, 12, len(data)):
        if name == b"LIST" and data[start : start + 4] == b"hdrl":
            step = next((int.from_bytes(data[s : s + 4], "little") for n, s, _ in riff_chunks(data, start + 4, end) if n == b"avih"), 0)
        elif name == b"LIST" and data[start : start + 4] == b"movi":
            movie, end_of_movie = start, min(end, len(data))
        elif name == b"idx1":
            index = np.frombuffer(data[start : start + (min(end, len(data)) - start) // 16 * 16], _INDEX)
    index = index[np.isin(np.char.lower(index["id"]), (b"00dc", b"00db"))]
    if not len(index):
        found = [(s, e) for n, s, e in riff_chunks(data, movie + 4, end_of_movie) if n in (b"00dc", b"00db")]
        return step or MICROSECONDS, [data[s:e] for s, e in found]
    first = int(index["at"][0])
    base = movie if data[movie + first : movie + first + 4] == bytes(index["id"][0]) else 0
    starts = (index["at"].astype(np.int64) + base + 8).tolist()
    return step or MICROSECONDS, [data[s : s + n] for s, n in zip(starts, index["size"].tolist(), strict=True)]


def decode_clip(frames: list[bytes]) -> np.ndarray | None:
    """Luminance samples of all frames: those of the usual head at once, others one by one. None if a frame can't be
    read, or if the frames have unlike sizes."""
    head = len(_HEAD)
    if all(f.startswith(_HEAD) and f.endswith(b"\xff\xd9") for f in frames):
        try:
            return decode_frames([f[head:-2] for f in frames])
        except ValueError:  # a frame is cut short
            return None
    try:
        samples = [jpeg.decode(f) for f in frames]
    except jpeg.Unreadable:
        return None
    return np.stack(samples) if len({x.shape for x in samples}) == 1 else None


def shots(samples: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) frame of each shot.

    A cut stands where the histogram difference to the frame before exceeds the mean of the last BACK differences by
    DEVIATIONS standard deviations; the window starts anew with the first two differences of the clip."""
    n = len(samples)
    flat = samples.reshape(n, -1).astype(np.int64) * BINS // 256 + np.arange(n)[:, None] * BINS
    histogram = np.bincount(flat.ravel(), minlength=n * BINS).reshape(n, BINS)
    change = np.abs(np.diff(histogram, axis=0)).sum(axis=1).astype(np.float64)
    one, two = np.concatenate([[0.0], np.cumsum(change)]), np.concatenate([[0.0], np.cumsum(change * change)])
    at = np.arange(len(change))
    low = np.maximum(at - BACK, 0)
    seen = np.maximum(at - low, 1)
    mean = (one[at] - one[low]) / seen
    spread = np.sqrt(np.maximum((two[at] - two[low]) / seen - mean * mean, 0))
    cuts = np.flatnonzero((at >= 2) & (change > mean + DEVIATIONS * np.maximum(spread, 1.0))) + 1
    edges = [0, *cuts.tolist(), n]
    return list(zip(edges[:-1], edges[1:], strict=True))


def _stored_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        rows: list[list] = [[] for _ in range(7)]
        for text in batch.column("text").to_pylist():
            raw = (text or "").encode()
            media = write_avi(np.frombuffer(raw + b" " * (-len(raw) % FRAME if raw else FRAME), np.uint8))
            step, frames = read_avi(media)
            samples = decode_clip(frames)
            payload = samples.tobytes()
            clips = shots(samples)
            feature = f"{len(frames)}x{WIDTH}x{HEIGHT};{step * len(frames) // 1000}ms;" + ",".join(str(s * step // 1000) for s, _ in clips)
            for column, value in zip(rows, (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature), strict=True):
                column.append(value)
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *[pa.array(r, t) for r, t in zip(rows, types, strict=True)]], ["doc_id", *names])


def media_digests(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text). Stores each text in an AVI file, reads it back and returns digests and the starts of its shots."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_stored_texts, schema)


def texts_to_avi(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, text). doc_id and the AVI file of each text."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            files = []
            for text in batch.column("text"):
                raw = (text.as_py() or "").encode()
                files.append(write_avi(np.frombuffer(raw + b" " * (-len(raw) % FRAME if raw else FRAME), np.uint8)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(files, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(write, "doc_id long, media binary")


def _shot_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shots of the files of each batch, slice by slice, so that no task holds many films as objects."""
    for batch in slices(batches, "media"):
        rows = []
        for key, value in zip(batch.column("id").to_pylist(), batch.column("media"), strict=True):
            data = value.as_py()  # one file at a time
            if data is None or data[:4] != b"RIFF" or data[8:12] != b"AVI ":
                continue
            step, frames = read_avi(data)
            if not frames:
                continue
            samples = decode_clip(frames)
            if samples is None:
                rows.append((key, None, 0, len(frames), 0, len(frames) * step // 1000, None))
                continue
            rows += [(key, k, s, e - s, s * step // 1000, e * step // 1000, float(samples[s:e].mean())) for k, (s, e) in enumerate(shots(samples))]
        names = ["id", "clip", "first_frame", "n_frames", "start_ms", "end_ms", "mean_sample"]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names)


def clip_rows(media: DataFrame, id_column: str = "doc_id", media_column: str = "media") -> DataFrame:
    """One row per shot of each AVI file: its id, clip number, first frame, frames, start and end in milliseconds and
    mean luminance sample. A null file, one that isn't an AVI file and one without frames have no clips. A film with a
    frame that can't be read (see jpeg.decode), or with frames of unlike sizes, gives one row with its frames and times,
    and null as clip and mean sample, as its shots aren't known."""

    schema = "id long, clip int, first_frame int, n_frames int, start_ms long, end_ms long, mean_sample double"
    return media.select(F.col(id_column).cast("long").alias("id"), F.col(media_column).alias("media")).mapInArrow(_shot_rows, schema).withColumnRenamed("id", id_column)
