"""Media columns: motion-JPEG AVI bytes in, timed clip rows out.

``clips`` decodes each AVI's intra frames (found through the RIFF index), takes a histogram of each, and
cuts where the difference to the frame before stands out: above ``SPREAD`` deviations over the mean of
the ``WINDOW`` differences before it, and above ``LEAST`` at all. So the threshold adapts to how lively
a film is. ``store_text`` is the lossless way in for bytes (see ``avi``).

Work is per row in Arrow batches, frames in slices of ``SLICE``, so memory holds one file and a slice.

Frames of other makers are read by their own tables (see ``avi.luma``); shots are found in luma.

Defined edge cases: null text is empty and becomes one block of zeros (one frame); a null AVI has no
clips; bytes that are no readable AVI give one row that has only the key and an error; a film without frames
has no clips; equal texts give equal bytes and features; repeated rows are handled
separately; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from dredge.llm import avi
from dredge.llm.common import documents, quoted

BINS = 16
WINDOW = 8
SPREAD = 3.0
LEAST = 0.25
SLICE = 256


def padded(text: str | None) -> tuple[int, bytes]:
    """Length of the UTF-8 bytes, and the bytes with zeros up to a positive multiple of 64."""
    raw = (text or "").encode()
    return len(raw), raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))


def store_text(text: str | None) -> tuple[int, bytes]:
    n, payload = padded(text)
    return n, avi.write_avi(payload)


def load(data: bytes) -> tuple[bytes, np.ndarray, float]:
    """The payload of an AVI made by ``store_text``, its frames' histograms, and its frames per second."""
    frames, head = avi.read_avi(data)
    parts, hists = [], []
    for i in range(0, len(frames), SLICE):
        coefs = avi.coefficients(frames[i : i + SLICE])
        parts.append(avi.payload_of(coefs))
        hists.append(histograms(avi.pixels(coefs)))
    payload = b"".join(parts)
    return payload[: head.get("payload_bytes", len(payload))], np.concatenate(hists) if hists else np.zeros((0, BINS), np.int64), head.get("fps", avi.FPS)


def frame_histograms(data: bytes) -> tuple[np.ndarray, float]:
    """The luma histograms of the frames of any motion-JPEG AVI, and its frames per second."""
    frames, head = avi.read_avi(data)
    if frames and avi.own_form(frames):
        return load(data)[1], head.get("fps", avi.FPS)
    rows = [histograms(avi.luma(f)[None])[0] for f in frames if f]  # an empty chunk repeats the frame before
    return np.array(rows, np.int64).reshape(-1, BINS), head.get("fps", avi.FPS)


def histograms(shown: np.ndarray) -> np.ndarray:
    """Counts of sample values in ``BINS`` bins, one row per frame."""
    n = len(shown)
    at = (shown.reshape(n, -1) >> 4).astype(np.int64) + BINS * np.arange(n)[:, None]
    return np.bincount(at.ravel(), minlength=n * BINS).reshape(n, BINS)


def cuts(hists: np.ndarray) -> np.ndarray:
    """Numbers of the frames that begin a new shot (besides the first)."""
    if len(hists) < 2:
        return np.zeros(0, np.int64)
    share = hists / hists.sum(axis=1, keepdims=True)
    d = np.abs(np.diff(share, axis=0)).sum(axis=1) / 2
    sums, squares = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    i = np.arange(len(d))
    lo = np.maximum(0, i - WINDOW)
    n = np.maximum(1, i - lo)
    mean = (sums[i] - sums[lo]) / n
    spread = np.sqrt(np.maximum(0, (squares[i] - squares[lo]) / n - mean * mean))
    return np.flatnonzero(d > np.maximum(LEAST, mean + SPREAD * spread)) + 1


def clip_rows(hists: np.ndarray, fps: float) -> list[tuple[int, int, int, float, float]]:
    """(clip, first frame, frames, start s, end s) of each shot."""
    edges = [0, *cuts(hists).tolist(), len(hists)]
    return [(k, a, b - a, a / fps, b / fps) for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))] if len(hists) else []


def clips(media: DataFrame, key: str, column: str) -> DataFrame:
    """Timed clip rows (key, clip, first_frame, frames, start_s, end_s, error) of a column of AVI bytes."""
    schema = StructType([StructField(key, media.schema[key].dataType), *[StructField(n, LongType()) for n in ("clip", "first_frame", "frames")], *[StructField(n, DoubleType()) for n in ("start_s", "end_s")], StructField("error", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                if not batch.column(1)[i].is_valid:
                    continue
                try:
                    rows = [(*r, None) for r in clip_rows(*frame_histograms(batch.column(1)[i].as_py()))]
                except (ValueError, IndexError, KeyError, struct.error) as e:
                    rows = [(None, None, None, None, None, f"{type(e).__name__}: {e}")]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string()]
                columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i] * len(rows), pa.int64())), *columns], schema.names)

    return media.select(quoted(key), quoted(column)).mapInArrow(run, schema)


def digest(text: str | None) -> tuple:
    """What the query returns of one text, read back from its stored form."""
    n, data = store_text(text)
    payload, hists, fps = load(data)
    shots = clip_rows(hists, fps)
    total = hists.sum(axis=0)
    feature = f"frames={len(hists)};shots={len(shots)};longest={max(s[2] for s in shots)};hist={','.join(map(str, total.tolist()))}"
    return (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an AVI, read back, and described."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [digest(t.as_py()) for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True)]], names)

    docs = documents(spark, sf_dir, "doc_id", "text")
    return docs.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
