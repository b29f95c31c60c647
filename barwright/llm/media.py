"""Media columns: motion-JPEG in AVI as a binary column, shots found in it, and texts stored in it.

`clips` parses the RIFF index of each file, decodes its frames (each for itself: they are intra frames), and finds shots where
the difference of neighbouring frames' histograms exceeds a threshold that adapts to the differences before it.
Everything is one scan without a shuffle; a task holds a part of a batch, cut by bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barwright.llm import bytesets, motion_jpeg

BINS = 16
#: A cut: the difference (0 to 2) exceeds this, and the mean of the differences before it in the shot by this many deviations.
LEAST, DEVIATIONS, HISTORY = 0.25, 3.0, 12
#: Bytes worked on at once.
PART = 1 << 20


def histograms(samples: np.ndarray, frame: np.ndarray, frames: int) -> np.ndarray:
    """The share of each of BINS levels in each frame. samples: 8-bit; frame: the frame of each."""
    counts = np.bincount(frame * BINS + (samples >> 4), minlength=frames * BINS).reshape(frames, BINS)
    return counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)


def shots(shares: np.ndarray) -> list[tuple[int, int]]:
    """First and last frame of each shot."""
    if not len(shares):
        return []
    differences = np.abs(np.diff(shares, axis=0)).sum(axis=1)
    out, begin = [], 0
    for i, d in enumerate(differences.tolist()):
        before = differences[max(begin, i - HISTORY) : i]
        limit = LEAST if not len(before) else max(LEAST, float(before.mean() + DEVIATIONS * before.std()))
        if d > limit:
            out.append((begin, i))
            begin = i + 1
    return [*out, (begin, len(shares) - 1)]


def encoded(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text's bytes, zeros appended up to a positive multiple of 64, as an AVI file.

    Null texts are empty. Rows with equal or null doc_ids have a file each; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytesets.chunks(batches, size=PART):
            data, offsets = bytesets.utf8(batch.column("text"))
            n = np.diff(offsets)
            blocks = np.maximum(-(-n // 64), 1)
            ends = np.cumsum(blocks)
            payload = np.zeros(int(blocks.sum()) * 64, np.uint8)
            payload[np.arange(len(data)) + np.repeat((ends - blocks) * 64 - offsets[:-1], n)] = data
            sizes = [min(motion_jpeg.FRAME_BLOCKS, b - k) for b in blocks.tolist() for k in range(0, b, motion_jpeg.FRAME_BLOCKS)]
            frames = motion_jpeg.frames_of(payload, np.array(sizes, np.int64))
            files, at = [], 0
            for b in blocks.tolist():
                own = -(-b // motion_jpeg.FRAME_BLOCKS)
                files.append(motion_jpeg.avi(frames[at : at + own], 8 * min(b, motion_jpeg.FRAME_BLOCKS)))
                at += own
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def digest(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature of each file of `encoded`, from its stored bytes.

    feature: the number of frames and the shots in milliseconds, from histograms of the samples read back. A row for each row,
    repeated and null doc_ids included; an empty table gives no rows.
    """
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bytesets.chunks(batches, "media", 2 * PART):
            files = batch.column("media").to_pylist()
            videos = [motion_jpeg.parse_avi(f) for f in files]
            blocks = motion_jpeg.coefficients([f for v in videos for f in v.frames])
            samples = (np.concatenate(blocks) - motion_jpeg.OFFSET).astype(np.uint8).reshape(-1) if blocks else np.zeros(0, np.uint8)
            sizes = np.array([b.size for b in blocks], np.int64)
            shares = histograms(samples, np.repeat(np.arange(len(blocks)), sizes), len(blocks))
            ends = np.cumsum(sizes)
            columns: list[list] = [[] for _ in names[2:]]
            at = 0
            for f, v in zip(files, videos, strict=True):
                own = slice(at, at + len(v.frames))
                payload = samples[ends[own.start] - sizes[own.start] : ends[own.stop - 1]].tobytes()
                found = ",".join(f"{round(a * v.milliseconds)}-{round((b + 1) * v.milliseconds)}" for a, b in shots(shares[own]))
                row = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(f), hashlib.sha256(f).hexdigest(), f"frames={len(v.frames)};shots={found}")
                for c, x in zip(columns, row, strict=True):
                    c.append(x)
                at = own.stop
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def clips(media: DataFrame, key: str = "media_id", column: str = "media") -> DataFrame:
    """key, clip, first_frame, last_frame, start_ms, end_ms: a row for each shot of each AVI file in a binary column.

    Null, empty and unreadable files (no AVI, or frames that are no one-component baseline JPEG) have one row, of a null clip;
    files without frames have none of frames: a null clip too. Rows with equal keys are kept apart.
    """
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, rows = [], []
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    video = motion_jpeg.parse_avi(data or b"")
                    images = [motion_jpeg.pixels(c, motion_jpeg.header(f)) for c, f in zip(motion_jpeg.coefficients(video.frames), video.frames, strict=True)]
                except (ValueError, IndexError, KeyError):
                    images = []
                found = shots(np.stack([histograms(x.reshape(-1), np.zeros(x.size, np.int64), 1)[0] for x in images])) if images else []
                new = [(i, a, b, a * video.milliseconds, (b + 1) * video.milliseconds) for i, (a, b) in enumerate(found)] or [(None,) * 5]
                rows += new
                keys += [name] * len(new)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([r[k] for r in rows], kinds[k]) for k in range(5))], names=[key, "clip", "first_frame", "last_frame", "start_ms", "end_ms"])

    return media.select(F.col(key).cast("string"), F.col(column).cast("binary")).mapInArrow(run, f"`{key}` string, clip int, first_frame int, last_frame int, start_ms double, end_ms double")
