"""Media columns: audio samples and log-mel features as fixed-shape tensors.

Bytes are stored losslessly as 8-bit PCM in a WAV container.  Reading resamples by a
polyphase filter, computes overlapped log-mel frames, and segments them by the
frames' energy with hysteresis.  Frames go into Arrow fixed-shape tensors
``(FRAMES, MELS)`` with the time span of each tensor.

Defined cases: null bytes or text count as empty; a payload is padded with zeros to a
positive multiple of 64, so an empty one has 64 zero bytes and one frame; equal
payloads have equal features; the last tensor of a recording is padded with the
floor value and its span tells the real end.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 16000  # of the stored samples
UP, DOWN = 1, 2  # to 8 kHz
WINDOW, HOP, MELS, FRAMES = 256, 128, 32, 64
TAPS = 16  # of each polyphase branch
FLOOR = 1e-10
HIGH_DB, LOW_DB = 3.0, -3.0  # against the recording's mean: a segment opens and closes
#: Frames transformed at once, which bounds memory for recordings of any length.
BLOCK_FRAMES = 4096


def padded(data: bytes, to: int = 64) -> bytes:
    return data + bytes(-len(data) % to if data else to)


def wav(samples: bytes, rate: int = RATE) -> bytes:
    """A canonical mono 8-bit PCM WAV file; RIFF asks for an even number of bytes."""
    n = len(samples)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", n)
    return head + samples + bytes(n % 2)


def unwav(data: bytes) -> tuple[int, bytes]:
    """(rate, samples) of an 8-bit mono WAV file; other chunks are skipped."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(data):
        name, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if name == b"fmt ":
            kind, channels, rate = struct.unpack_from("<HHI", data, at + 8)
            if (kind, channels, struct.unpack_from("<H", data, at + 22)[0]) != (1, 1, 8):
                raise ValueError("only mono 8-bit PCM is stored here")
        elif name == b"data":
            return rate, data[at + 8 : at + 8 + n]
        at += 8 + n + n % 2
    raise ValueError("no data chunk")


@lru_cache
def _prototype(up: int, down: int) -> np.ndarray:
    """Windowed-sinc low-pass for resampling by up/down, as one branch a row."""
    m = max(up, down)
    n = TAPS * m + 1  # odd, so the delay is a whole number of steps
    t = (np.arange(n) - (n - 1) / 2) / m
    h = np.sinc(t) * np.hamming(n)
    h *= up / h.sum()
    return h.astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase resampling of float32 samples; the output has ceil(len * up / down) samples."""
    h = _prototype(up, down)
    delay, n_out = (len(h) - 1) // 2, -(-len(x) * up // down)
    out = np.zeros(n_out, np.float32)
    pad = len(h) // up + 1
    xp = np.concatenate([np.zeros(pad, np.float32), x, np.zeros(pad + down, np.float32)])
    # output m sits at m*down + delay of the up-sampled line; branch = that mod up
    for first in range(min(up, n_out)):
        m = np.arange(first, n_out, up)
        at = m * down + delay
        phase = int(at[0] % up)
        taps = h[phase::up]
        start = at // up + pad  # the newest input sample under the filter
        for k, c in enumerate(taps):  # strided adds: no gathered copy of the input
            step = (start[1] - start[0]) if len(start) > 1 else 1
            lo = start[0] - k
            out[first::up] += c * xp[lo : lo + step * (len(m) - 1) + 1 : step]
    return out


@lru_cache
def _mel_bank(rate: int, window: int, mels: int) -> np.ndarray:
    """Triangular filters, equally spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(0), mel(rate / 2), mels + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(window, 1 / rate)
    up = (bins - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - bins) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)).T.astype(np.float32)


def log_mel(x: np.ndarray, rate: int) -> np.ndarray:
    """(frames, MELS) natural-log mel energies; the tail is padded to a whole frame."""
    n = max(1, -(-max(0, len(x) - WINDOW) // HOP) + 1)
    x = np.concatenate([x, np.zeros((n - 1) * HOP + WINDOW - len(x), np.float32)])
    shape = np.hanning(WINDOW + 1)[:-1].astype(np.float32)
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    bank, out = _mel_bank(rate, WINDOW, MELS), np.empty((n, MELS), np.float32)
    for i in range(0, n, BLOCK_FRAMES):
        spec = np.fft.rfft(frames[i : i + BLOCK_FRAMES] * shape)
        power = (spec.real**2 + spec.imag**2).astype(np.float32)
        out[i : i + BLOCK_FRAMES] = np.log(power @ bank + FLOOR)
    return out


def segments(mel: np.ndarray, high: float = HIGH_DB, low: float = LOW_DB) -> list[tuple[int, int]]:
    """Frame ranges [from, to): open above ``high`` dB over the mean energy, closed below ``low``."""
    db = 10 / np.log(10) * mel.max(axis=1)
    db = db - db.mean()
    state = np.where(db >= high, 1, np.where(db < low, 0, -1))
    known = np.where(state >= 0, np.arange(len(db)), -1)
    last = np.maximum.accumulate(known)
    on = np.where(last >= 0, state[last] == 1, False)
    edges = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def features(samples: bytes, rate: int = RATE) -> tuple[np.ndarray, list[tuple[int, int]], float]:
    """Log-mel frames, segments, and seconds per frame step of 8-bit samples."""
    x = (np.frombuffer(samples, np.uint8).astype(np.float32) - 128) / 128
    out_rate = rate * UP // DOWN
    mel = log_mel(resample(x), out_rate)
    return mel, segments(mel), HOP / out_rate


def media_column(df: DataFrame, payload: str, out: str = "media") -> DataFrame:
    """Replace the binary column ``payload`` by its WAV bytes in ``out``; another column of that name goes."""
    df = df if out == payload else df.drop(out)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = None
        for b in batches:
            at = b.schema.get_field_index(payload)
            made = pa.array([wav(padded(v or b"")) for v in b.column(at).to_pylist()], pa.binary())
            cols = [made if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(cols, names=[out if n == payload else n for n in b.schema.names])

    fields = ", ".join(f"`{out if c == payload else c}` {'binary' if c == payload else t}" for c, t in df.dtypes)
    return df.mapInArrow(encode, fields)


def tensor_rows(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """(key, tensor_no, from_s, to_s, frames, tensor): FRAMES x MELS floats a row, row-major.

    The tensor column is a list of FRAMES * MELS float values; ``as_tensors`` gives the
    Arrow fixed-shape tensor of a batch.  Long recordings give more rows, not longer ones.
    """
    kind = dict(df.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                mel, _, step = features(*reversed(unwav(v)))
                n = -(-len(mel) // FRAMES)
                full = np.full((n * FRAMES, MELS), np.log(FLOOR), np.float32)
                full[: len(mel)] = mel
                begin = np.arange(n) * FRAMES
                end = np.minimum(begin + FRAMES, len(mel))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k] * n, b.schema.field(0).type), pa.array(range(n), pa.int32()), pa.array(begin * step), pa.array(end * step), pa.array(end - begin, pa.int32()),
                     pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * FRAMES * MELS, pa.int32()), pa.array(full.ravel()))],
                    names=["key", "tensor_no", "from_s", "to_s", "frames", "tensor"],
                )

    return df.select(key, media).mapInArrow(run, f"key {kind}, tensor_no int, from_s double, to_s double, frames int, tensor array<float>").withColumnRenamed("key", key)


def as_tensors(column: pa.ListArray | pa.ChunkedArray) -> pa.FixedShapeTensorArray:
    """The fixed-shape tensor array of a tensor column read into Arrow."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = pa.FixedSizeListArray.from_arrays(column.flatten(), FRAMES * MELS)
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), (FRAMES, MELS)), flat)


SUMMARY_SCHEMA = (
    "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "seconds double, n_frames int, tensor_shape string, spans array<struct<from_s: double, to_s: double>>"
)


def with_tensors(df: DataFrame, media: str = "media") -> DataFrame:
    """Add ``tensors``: the (FRAMES, MELS) float32 values of each tensor, row-major, with its number of frames and time span.

    An existing column of that name is replaced.
    """
    df = df.drop("tensors")
    item = pa.struct([("from_s", pa.float64()), ("to_s", pa.float64()), ("frames", pa.int32()), ("tensor", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(media)
            for k, v in enumerate(b.column(at)):
                mel, _, step = features(*reversed(unwav(v.as_py())))
                n = -(-len(mel) // FRAMES)
                full = np.full((n * FRAMES, MELS), np.log(FLOOR), np.float32)
                full[: len(mel)] = mel
                rows = [{"from_s": i * step, "to_s": min(i + FRAMES, len(mel)) * step, "frames": min(FRAMES, len(mel) - i), "tensor": full[i : i + FRAMES].tobytes()} for i in range(0, n * FRAMES, FRAMES)]
                yield pa.RecordBatch.from_arrays([*(c.slice(k, 1) for c in b.columns), pa.array([rows], pa.list_(item))], names=[*b.schema.names, "tensors"])

    fields = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInArrow(run, f"{fields}, tensors array<struct<from_s: double, to_s: double, frames: int, tensor: binary>>")


def frames_of(tensors: list[dict]) -> np.ndarray:
    """The (frames, MELS) log-mel values of a row's tensors read back, without the padding."""
    return np.concatenate([np.frombuffer(t["tensor"], np.float32).reshape(FRAMES, MELS)[: t["frames"]] for t in tensors])


def summaries(df: DataFrame, media: str = "media") -> DataFrame:
    """One row per media row: digests of the bytes read back, a feature string and time spans.

    The feature string has the mean and spread of each mel band and the number of segments.  With a ``tensors``
    column (``with_tensors``) frames, shape and spans come from it, else they are computed here.
    Columns named as those of ``SUMMARY_SCHEMA`` are replaced.
    """
    df = df.drop(*(x.strip().split(" ")[0] for x in SUMMARY_SCHEMA.split(", ")[:10]))
    stored = "tensors" in df.columns
    kept = [(c, t) for c, t in df.dtypes if c not in (media, "tensors")]
    spans_type = pa.list_(pa.struct([("from_s", pa.float64()), ("to_s", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = b.schema.get_field_index(media)
            out = []
            tensors = b.column(b.schema.get_field_index("tensors")) if stored else None
            for k, v in enumerate(b.column(at)):
                data = v.as_py()
                rate, samples = unwav(data)
                if stored:
                    own = tensors[k].as_py()
                    mel, step, n = frames_of(own), HOP / (rate * UP // DOWN), len(own)
                    spans = segments(mel)
                else:
                    mel, spans, step = features(samples, rate)
                    n = -(-len(mel) // FRAMES)
                text = ",".join(f"{x:.3f}" for x in np.concatenate([mel.mean(axis=0, dtype=np.float64), mel.std(axis=0, dtype=np.float64)]))
                out.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-64:]), len(data), hashlib.sha256(data).hexdigest(), f"{len(spans)};{text}",
                            len(samples) / rate, len(mel), f"{n}x{FRAMES}x{MELS}", [{"from_s": a * step, "to_s": z * step} for a, z in spans]))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.string(), spans_type]
            cols = [pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [()] * len(types), types, strict=True)]
            keep = [i for i, c in enumerate(b.schema.names) if c not in (media, "tensors")]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), *cols], names=[*(b.schema.names[i] for i in keep), *(x.strip().split(" ")[0] for x in SUMMARY_SCHEMA.split(", ")[:10])])

    fields = ", ".join(f"`{c}` {t}" for c, t in kept)
    return df.mapInArrow(run, f"{fields}, {SUMMARY_SCHEMA}")


def text_payload(df: DataFrame, text: str = "text", out: str = "payload") -> DataFrame:
    """The UTF-8 bytes of a text column (null: empty), in place of a column ``out`` if there is one."""
    return df.withColumn(out, F.encode(F.coalesce(text, F.lit("")), "UTF-8"))
