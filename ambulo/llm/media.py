"""Media columns: texts as WAV clips with spectral-peak fingerprints.

A clip is stored as the bytes of a WAV file (mono, 8 bits).  Decoding reads it
with the wave module, takes short-time Fourier transforms of frames that don't
overlap, keeps the strongest bin of each frame as its one peak and pairs each
peak with those of the next frames.  A pair of frequencies and their distance
in time make one code, stored with its time.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ambulo.llm.common import byte_rows, parts_of

UNIT = 192
RATE = 8000
FRAME = 256
#: Frames after a peak whose peaks it is paired with.
FAN_OUT = 3
#: Clips of a batch that are held at a time.
AT_ONCE = 256


def pad(text: bytes) -> bytes:
    """text and spaces up to a positive multiple of UNIT bytes."""
    return text + b" " * (-len(text) % UNIT if text else UNIT)


def to_wav(payload: bytes) -> bytes:
    """A mono 8-bit WAV file whose samples are the payload."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(1)
        f.setframerate(RATE)
        f.writeframes(payload)
    return out.getvalue()


def from_wav(data: bytes) -> bytes:
    """The samples of a WAV file, read with the wave module."""
    with wave.open(io.BytesIO(data), "rb") as f:
        return f.readframes(f.getnframes())


def peak_pairs(samples: bytes, chunk: int = 2048) -> tuple[np.ndarray, np.ndarray]:
    """(time, code) arrays: frame numbers and 32-bit codes of the pairs of spectral peaks."""
    x = np.frombuffer(samples, np.uint8)
    x = np.pad(x, (0, -len(x) % FRAME), constant_values=128)
    window = np.hanning(FRAME)
    frames, peaks = x.reshape(-1, FRAME), []
    for i in range(0, len(frames), chunk):
        power = np.abs(np.fft.rfft((frames[i : i + chunk] - 128.0) * window, axis=1))
        # in steps of a relative 2**-20, so that rounding doesn't decide between equal peaks: the lowest one counts
        peaks.append(np.round(np.log2(power[:, 1:] + 1e-3) * 2**20).argmax(axis=1) + 1)
    peak = np.concatenate(peaks).astype(np.int64)
    times, codes = [], []
    for ahead in range(1, FAN_OUT + 1):
        if len(peak) > ahead:
            times.append(np.arange(len(peak) - ahead))
            codes.append(peak[:-ahead] << 16 | peak[ahead:] << 4 | ahead)
    if not times:  # a single frame: its peak alone
        return np.zeros(1, np.int32), (peak[:1] << 16).astype(np.int32)
    times, codes = np.concatenate(times), np.concatenate(codes)
    order = np.lexsort((codes, times))
    return times[order].astype(np.int32), codes[order].astype(np.int32)


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id long, n_bytes long, media binary): every whole text as a WAV file.

    docs: (doc_id, text, ...).  Null text counts as empty.  Repeated rows,
    null ids and empty tables pass through; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts_of(batches, AT_ONCE):
            texts = list(byte_rows(part, 1))
            media = pa.array([to_wav(pad(t)) for t in texts], pa.binary())
            yield pa.record_batch([part.column(0), pa.array([len(t) for t in texts], pa.int64()), media], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


DECODED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, times array<int>, codes array<int>"


def decode_media(clips: DataFrame) -> DataFrame:
    """Read clips (doc_id, n_bytes, media) back and fingerprint them.

    Adds digests of the samples and of the stored file, and the time-coded
    fingerprint: times (frame numbers) and codes (f1 << 16 | f2 << 4 | frames
    between), sorted by time.  A null medium gives nulls.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, AT_ONCE):
                part = batch.slice(i, AT_ONCE)
                rows = []
                for media in part.column(2):
                    data = media.as_py()
                    if data is None:
                        rows.append((None,) * 7)
                        continue
                    payload = from_wav(data)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), *peak_pairs(payload)))
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()))
                columns = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.record_batch([part.column(0), part.column(1), *columns], [x.split()[0] for x in DECODED.split(", ")])

    return clips.select("doc_id", "n_bytes", "media").mapInArrow(run, DECODED)


def feature_digest(times: str = "times", codes: str = "codes") -> Column:
    """A short text for a fingerprint: its number of pairs and a digest of all ``time:code`` pairs."""
    pairs = F.array_join(F.transform(F.arrays_zip(F.col(times).alias("t"), F.col(codes).alias("c")), lambda p: F.concat(p["t"].cast("string"), F.lit(":"), p["c"].cast("string"))), ",")
    return F.concat_ws(":", F.size(times), F.sha2(pairs, 256))
