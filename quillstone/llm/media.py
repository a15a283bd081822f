"""Media columns: WAV payloads, short-time Fourier transforms and spectral-peak fingerprints.

``encode_wav(df)`` stores each text's UTF-8 bytes, padded with zero bytes to a
positive multiple of ``BLOCK``, as the samples of an 8-bit mono WAV file, reads
the file back with the ``wave`` module, takes a short-time Fourier transform of
the samples and keeps its strongest peaks. Each peak is paired with the next
``FAN`` peaks within ``REACH`` frames; a pair is stored as a code (two bins and
the frames between them) with the frame at which it starts.

Defined cases: a null text is the empty text; the empty text is one block of
zero bytes and has no peaks; equal texts give equal files and fingerprints;
repeated rows stay repeated; of equally strong bins of a frame the lowest is its
peak, and equally strong frames side by side are all peaks; a text of any length is
taken whole, its frames in pieces; an empty table gives an empty table; other columns
are dropped unless named in ``keep``, so clashing names cannot arise.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, map_batches, row_slices, text_buffers

BLOCK = 64  #: payload bytes come in multiples of this
RATE = 8000  #: frames a second named in the WAV header
FRAME = 256  #: samples of a Fourier frame
HOP = 128  #: samples between two frames
FAN = 3  #: later peaks that a peak is paired with
REACH = 32  #: frames that may lie between the two
PIECE = 2048  #: frames transformed at once
SPREAD = 2  #: a peak is the strongest of as many frames on either side

_WINDOW = np.hanning(FRAME + 1)[:FRAME].astype(np.float32)


def write_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def read_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as w:
        return w.readframes(w.getnframes())


def pad(text: bytes) -> bytes:
    return text + bytes(-len(text) % BLOCK or (BLOCK if not text else 0))


def strongest(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(strongest bin, its rounded magnitude) of each frame, without the frame's mean level; the tail is silence.

    Frames are transformed PIECE at a time, so that a text of any length takes bounded memory.
    """
    n = max(1, -(-(len(samples) - FRAME) // HOP) + 1)
    level = np.float32(samples.mean())
    bins, tops = np.zeros(n, np.int64), np.zeros(n, np.int64)
    for lo in range(0, n, PIECE):
        hi = min(n, lo + PIECE)
        mine = samples[lo * HOP : (hi - 1) * HOP + FRAME]
        x = np.zeros((hi - lo - 1) * HOP + FRAME, np.float32)
        x[: len(mine)] = mine - level
        frames = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP]
        mags = np.abs(np.fft.rfft((frames - frames.mean(1, keepdims=True)) * _WINDOW, axis=1))[:, 1:-1]
        bins[lo:hi] = mags.argmax(1)
        tops[lo:hi] = np.rint(mags[np.arange(hi - lo), bins[lo:hi]])
    return bins, tops


def fingerprint(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(times, codes) of the spectral-peak pairs, in order of time, then of the partner."""
    bins, tops = strongest(samples)
    best = tops.copy()
    for d in range(1, SPREAD + 1):
        best[d:] = np.maximum(best[d:], tops[:-d])
        best[:-d] = np.maximum(best[:-d], tops[d:])
    at = np.flatnonzero((tops == best) & (tops > 0))
    times, codes, order = [], [], []
    for k in range(1, FAN + 1):
        a, b = at[:-k], at[k:]
        near = b - a <= REACH
        a, b = a[near], b[near]
        times.append(a)
        codes.append((bins[a] << 14) | (bins[b] << 7) | (b - a))
        order.append(np.full(len(a), k))
    times, codes, order = (np.concatenate(x) for x in (times, codes, order))
    by = np.lexsort((order, times))
    return times[by].astype(np.int32), codes[by].astype(np.int32)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32), pa.int32()))


def _encode(batch: pa.RecordBatch) -> Iterator[dict]:
    data, ends = text_buffers(batch.column(1))
    for lo, hi in row_slices(ends):
        media, back, times, codes = [], [], [], []
        for i in range(lo, hi):
            wav = write_wav(pad(data[ends[i] : ends[i + 1]].tobytes()))
            samples = read_wav(wav)
            t, c = fingerprint(np.frombuffer(samples, np.uint8))
            media.append(wav)
            back.append(samples)
            times.append(t)
            codes.append(c)
        yield {
            "id": batch.column(0).slice(lo, hi - lo),
            "n_bytes": np.diff(ends[lo : hi + 1]),
            "media": pa.array(media, pa.binary()),
            "payload": pa.array(back, pa.binary()),
            "fp_times": _lists(times),
            "fp_codes": _lists(codes),
        }


def encode_wav(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media, payload read back, fp_times, fp_codes) for each row of ``df``."""
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col), F.col(text_col).cast("string"))
    return map_batches(rows, _encode, f"`{id_col}` {kind}, n_bytes long, media binary, payload binary, fp_times array<int>, fp_codes array<int>")


def op10_media(spark, sf_dir: str) -> DataFrame:
    x = encode_wav(load(spark, sf_dir, "documents"))
    pairs = F.concat_ws(",", F.zip_with("fp_times", "fp_codes", lambda t, c: F.concat_ws(":", t, c)))
    return x.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -BLOCK, BLOCK)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(":", F.size("fp_times"), F.sha2(pairs.cast("binary"), 256)).alias("feature"),
        "fp_times",
        "fp_codes",
    )


QUERIES = {"op10_media": op10_media}
ORACLES: dict[str, str] = {}
