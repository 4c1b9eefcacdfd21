"""Media columns: audio features of 8-bit PCM samples.

Each text's UTF-8 bytes, padded with spaces to a positive multiple of 192, are stored as an 8-bit mono WAV, read back,
resampled by a polyphase filter, cut into overlapped frames, turned into log-mel tensors of one fixed shape with time
spans, and segmented by energy with two thresholds (hysteresis).

Edge cases: a null or empty text is 192 spaces (silence: no active segment). Long texts are worked on in pieces of
bounded size, with the same result as in one go. Repeated rows give repeated rows. An empty table gives an empty
result. Other columns of the input are ignored, so clashing names do no harm.
"""

from __future__ import annotations

import hashlib
import io
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

PAD = 192
RATE, UP, DOWN = 12_000, 2, 3
TAPS = 16
FRAME, HOP, MELS = 256, 160, 20
BLOCK = 64  # frames in a tensor
PIECE = 1 << 16  # resampled samples worked on at once
FLOOR_DB, HIGH_DB, LOW_DB = -80.0, 1.0, -1.0


def pad(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + b" " * (-len(raw) % PAD or (0 if raw else PAD)), len(raw)


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(stored: bytes) -> bytes:
    with wave.open(io.BytesIO(stored), "rb") as w:
        return w.readframes(w.getnframes())


def polyphase_bank(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """A Hamming-windowed sinc low-pass, dealt into `up` phases of `taps` coefficients each."""
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(up, down)) / max(up, down) * np.hamming(n) * up
    return h.reshape(taps, up).T[:, ::-1].astype(np.float32)


def mel_bank(rate: float, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangular filters whose corners lie at equal steps of the mel scale."""
    mel = np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), mels + 2)
    corner = 700 * (10 ** (mel / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)[:, None]
    rise, fall = (f - corner[:-2]) / (corner[1:-1] - corner[:-2]), (corner[2:] - f) / (corner[2:] - corner[1:-1])
    return np.clip(np.minimum(rise, fall), 0, None).astype(np.float32)


BANK = polyphase_bank()
MEL = mel_bank(RATE * UP / DOWN)
WINDOW = np.hanning(FRAME).astype(np.float32)


def resample(samples: np.ndarray) -> np.ndarray:
    """By UP / DOWN: every output sample is the dot product of one phase with TAPS neighbouring input samples."""
    out = np.empty(len(samples) * UP // DOWN, np.float32)
    padded = np.concatenate([np.zeros(TAPS // 2, np.float32), samples, np.zeros(TAPS, np.float32)])
    view = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    for r in range(UP):
        part = out[r::UP]
        taps, first = BANK[(r * DOWN) % UP], r * DOWN // UP
        for at in range(0, len(part), PIECE):
            n = min(PIECE, len(part) - at)
            part[at : at + n] = view[first + at * DOWN :: DOWN][:n] @ taps
    return out


def log_mel(signal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel values in dB, one row a frame, and the energy in dB of each frame without its constant part; at least one frame."""
    n = max(1, -(-max(0, len(signal) - FRAME) // HOP) + 1)
    signal = np.concatenate([signal, np.zeros((n - 1) * HOP + FRAME - len(signal), np.float32)])
    view = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    mels, energy, step = np.empty((n, MELS), np.float32), np.empty(n, np.float32), PIECE // HOP
    for at in range(0, n, step):
        power = np.abs(np.fft.rfft(view[at : at + step] * WINDOW, axis=1)) ** 2 / FRAME
        mels[at : at + step] = power.astype(np.float32) @ MEL
        energy[at : at + step] = power[:, 1:].sum(axis=1)
    low = 10 ** (FLOOR_DB / 10)
    return 10 * np.log10(np.maximum(mels, low)), 10 * np.log10(np.maximum(energy, low))


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """Frame spans [from, to) that start at mean + HIGH_DB and go on until below mean + LOW_DB."""
    level = energy - energy.mean()
    mark = np.where(level >= HIGH_DB, 1, np.where(level < LOW_DB, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.concatenate([[False], (last >= 0) & (mark[last] == 1), [False]])
    edge = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def features(payload: bytes) -> tuple[np.ndarray, list[tuple[int, int]]]:
    samples = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
    mels, energy = log_mel(resample(samples))
    return mels, segments(energy)


def millis(frame: int) -> int:
    return frame * HOP * 1000 * DOWN // (RATE * UP)


def tensors(mels: np.ndarray) -> pa.ExtensionArray:
    """Blocks of BLOCK frames as one Arrow fixed-shape tensor array; the last block is filled with FLOOR_DB."""
    blocks = -(-len(mels) // BLOCK)
    full = np.full((blocks * BLOCK, MELS), FLOOR_DB, np.float32)
    full[: len(mels)] = mels
    kind = pa.fixed_shape_tensor(pa.float32(), (BLOCK, MELS))
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(full.ravel(), BLOCK * MELS))


def stored_tensors(mels: np.ndarray) -> bytes:
    """An Arrow stream of one record a block: the fixed-shape tensor and the time span that it covers."""
    blocks = tensors(mels)
    begin = np.arange(len(blocks)) * BLOCK
    batch = pa.RecordBatch.from_arrays([pa.array([millis(int(i)) for i in begin], pa.int64()), pa.array([millis(int(i)) for i in np.minimum(begin + BLOCK, len(mels))], pa.int64()), blocks], names=["start_ms", "end_ms", "tensor"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(stored: bytes) -> pa.Table:
    """(start_ms, end_ms, tensor) of `stored_tensors`, with the tensor type."""
    with pa.ipc.open_stream(stored) as r:
        return r.read_all()


def _rows(batches: Iterator[pa.RecordBatch], with_tensors: bool) -> Iterator[pa.RecordBatch]:
    """Rows leave in small batches, since a text's tensors are larger than the text."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            out: dict[str, list] = {k: [] for k in ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "spans", "media", "blocks")}
            part = batch.slice(at, 256)
            for text in part.column(1):
                payload, n = pad(text.as_py())
                stored = to_wav(payload)
                back = from_wav(stored)
                mels, spans = features(back)
                quantised = np.rint(mels * 4).astype("<i2")
                mean = quantised.mean(axis=0) / 4
                out["n_bytes"].append(n)
                out["payload_bytes"].append(len(back))
                out["payload_sha256"].append(hashlib.sha256(back).hexdigest())
                out["tail_crc32"].append(zlib.crc32(back[-16:]))
                out["media_bytes"].append(len(stored))
                out["media_sha256"].append(hashlib.sha256(stored).hexdigest())
                out["feature"].append(f"frames={len(mels)};active={sum(b - a for a, b in spans)};segments={len(spans)};mean={','.join(f'{v:.1f}' for v in mean)};tensor={hashlib.md5(quantised.tobytes()).hexdigest()}")
                if with_tensors:
                    out["spans"].append([{"start_ms": millis(a), "end_ms": millis(b)} for a, b in spans])
                    out["media"].append(stored)
                    out["blocks"].append(stored_tensors(mels))
            made = {"id": part.column(0)} | {k: pa.array(v, _TYPES.get(k)) for k, v in out.items() if with_tensors or k not in ("spans", "media", "blocks")}
            yield pa.RecordBatch.from_pydict(made)


_SPAN = [("start_ms", pa.int64()), ("end_ms", pa.int64())]
_TYPES = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "payload_sha256": pa.string(), "media_sha256": pa.string(), "feature": pa.string(), "media": pa.binary(), "spans": pa.list_(pa.struct(_SPAN)), "blocks": pa.binary()}
_DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_FULL = _DIGEST + ", spans array<struct<start_ms: long, end_ms: long>>, media binary, blocks binary"


def audio_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_tensors: bool = True) -> DataFrame:
    """One row a document: digests of the payload and the stored WAV, a feature summary and, if asked for, the WAV,
    the active spans and the log-mel blocks (`stored_tensors`: fixed-shape tensors of BLOCK x MELS floats with their spans).
    No shuffle: every text is worked on where it is read."""
    kind = dict(docs.dtypes)[id_col]
    schema = f"id {kind}, {_FULL if with_tensors else _DIGEST}"
    return docs.select(id_col, text_col).mapInArrow(lambda it: _rows(it, with_tensors), schema).withColumnRenamed("id", id_col)
