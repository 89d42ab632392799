"""Audio columns: bytes to WAV and back, polyphase resampling, log-mel filterbanks, hysteresis segments.

Rules for odd input: a null text is an empty one; an empty text pads to one 192-byte block. Columns of the input that are
not asked for are not read. Repeated rows each give a row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

BLOCK = 192


@dataclass(frozen=True)
class AudioSpec:
    rate: int = 8000
    target_rate: int = 6000
    frame: int = 150
    hop: int = 60
    n_fft: int = 256
    n_mels: int = 20
    tensor_frames: int = 32
    enter_db: float = 3.0
    leave_db: float = 0.0
    chunk_frames: int = 4096


def pad_payload(data: bytes) -> bytes:
    return data + b" " * (BLOCK - len(data) if not data else -len(data) % BLOCK)


def wav_encode(samples: bytes, rate: int) -> bytes:
    """8-bit unsigned mono PCM in a RIFF file; a data chunk of odd length gets its pad byte."""
    pad = b"\0" * (len(samples) % 2)
    head = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    data = struct.pack("<4sI", b"data", len(samples)) + samples + pad
    return struct.pack("<4sI4s", b"RIFF", 4 + len(head) + len(data), b"WAVE") + head + data


def wav_decode(blob: bytes) -> tuple[int, bytes]:
    if blob[:4] != b"RIFF" or blob[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(blob):
        kind, size = struct.unpack_from("<4sI", blob, at)
        if kind == b"fmt ":
            rate = struct.unpack_from("<I", blob, at + 12)[0]
        elif kind == b"data":
            return rate, blob[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data chunk")


@lru_cache(maxsize=8)
def _filter(up: int, down: int) -> np.ndarray:
    """Windowed-sinc low-pass split in `up` phases, one row each."""
    half = 8 * max(up, down)
    n = np.arange(-half, half + 1)
    cut = 1.0 / max(up, down)
    taps = np.sinc(n * cut) * cut * np.hamming(len(n)) * up
    taps = np.pad(taps, (0, -len(taps) % up))
    return taps.reshape(-1, up).T.copy()


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Polyphase: output j reads phase (j*down) % up of the filter over the samples before (j*down) // up."""
    phases = _filter(up, down)
    width = phases.shape[1]
    lead = 8 * max(up, down)
    n_out = -(-len(x) * up // down)
    at = np.arange(n_out) * down + lead
    padded = np.concatenate([np.zeros(width), x, np.zeros(width + lead)])
    out = np.empty(n_out)
    for lo in range(0, n_out, 1 << 16):
        j = at[lo : lo + (1 << 16)]
        first = j // up + width
        window = padded[first[:, None] - np.arange(width)]
        out[lo : lo + len(j)] = np.einsum("ij,ij->i", window, phases[j % up])
    return out


@lru_cache(maxsize=8)
def mel_bank(rate: int, n_fft: int, n_mels: int) -> np.ndarray:
    def mel(f):
        return 2595 * np.log10(1 + np.asarray(f) / 700)

    edges = 700 * (10 ** (np.linspace(mel(20), mel(rate / 2), n_mels + 2) / 2595) - 1)
    freq = np.fft.rfftfreq(n_fft, 1 / rate)
    lo, mid, hi = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.clip(np.minimum((freq - lo) / (mid - lo), (hi - freq) / (hi - mid)), 0, None).T


def log_mel(x: np.ndarray, spec: AudioSpec) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (log-mel frames, frame energies in dB); the signal is padded to a frame and whole hops."""
    x = np.pad(x, (0, spec.frame - len(x) if len(x) < spec.frame else -(len(x) - spec.frame) % spec.hop))
    frames = np.lib.stride_tricks.sliding_window_view(x, spec.frame)[:: spec.hop]
    window, bank = np.hanning(spec.frame), mel_bank(spec.target_rate, spec.n_fft, spec.n_mels)
    for lo in range(0, len(frames), spec.chunk_frames):
        part = frames[lo : lo + spec.chunk_frames]
        power = np.abs(np.fft.rfft(part * window, spec.n_fft)) ** 2
        yield np.log(power @ bank + 1e-6), 10 * np.log10((part**2).mean(axis=1) + 1e-9)


def hysteresis(energy: np.ndarray, enter: float, leave: float) -> list[tuple[int, int]]:
    """Half-open frame runs that start at or above `enter` and last until energy falls below `leave`."""
    state = np.where(energy >= enter, 1, np.where(energy < leave, -1, 0))
    marks = np.where(state == 0, -1, np.arange(len(state)))
    last = np.maximum.accumulate(marks)
    on = (last >= 0) & (state[np.maximum(last, 0)] == 1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.view(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def audio_rows(blob: bytes, spec: AudioSpec) -> tuple[bytes, list[dict], list[dict]]:
    """(payload read back, fixed-shape tensors with spans in ms, voiced segments in ms)."""
    rate, payload = wav_decode(blob)
    x = (np.frombuffer(payload, np.uint8).astype(float) - 128) / 128
    gcd = int(np.gcd(rate, spec.target_rate))
    y = resample(x - (x.mean() if len(x) else 0), spec.target_rate // gcd, rate // gcd)
    mels, energies = zip(*log_mel(y, spec), strict=True)
    mel, energy = np.concatenate(mels).astype(np.float32), np.concatenate(energies)
    ms = 1000 * spec.hop / spec.target_rate
    tensors = []
    for lo in range(0, len(mel), spec.tensor_frames):
        part = mel[lo : lo + spec.tensor_frames]
        full = np.full((spec.tensor_frames, spec.n_mels), np.float32(np.log(1e-6)))
        full[: len(part)] = part
        tensors.append({"start_ms": lo * ms, "end_ms": (lo + len(part)) * ms, "frames": len(part), "tensor": full.ravel()})
    floor = float(np.median(energy))
    runs = hysteresis(energy, floor + spec.enter_db, floor + spec.leave_db)
    return payload, tensors, [{"start_ms": a * ms, "end_ms": b * ms} for a, b in runs]


def tensor_array(tensors: list[np.ndarray], spec: AudioSpec):
    """Arrow fixed-shape tensor array [tensor_frames, n_mels] of a collected column."""
    import pyarrow as pa

    kind = pa.fixed_shape_tensor(pa.float32(), (spec.tensor_frames, spec.n_mels))
    flat = pa.array(np.concatenate([np.zeros(0, np.float32), *tensors]), pa.float32())
    return pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(flat, spec.tensor_frames * spec.n_mels))


def tensor_bytes(tensors: list[np.ndarray], spec: AudioSpec) -> bytes:
    """The stored form: an Arrow IPC stream of one fixed-shape tensor column."""
    import pyarrow as pa

    batch = pa.record_batch([tensor_array(tensors, spec)], names=["tensor"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def read_tensors(blob: bytes) -> np.ndarray:
    """(tensors, tensor_frames, n_mels) of tensor_bytes()."""
    import pyarrow as pa

    with pa.ipc.open_stream(blob) as stream:
        return stream.read_all()["tensor"].combine_chunks().to_numpy_ndarray()


AUDIO_SCHEMA = """doc_id long, media binary, payload binary, n_bytes long,
tensors array<struct<start_ms double, end_ms double, frames int, tensor array<float>>>,
segments array<struct<start_ms double, end_ms double>>, tensor_arrow binary"""


def _decoded(texts: pd.Series, spec: AudioSpec):
    for text in texts:
        data = ("" if text is None else text).encode()
        media = wav_encode(pad_payload(data), spec.rate)
        yield len(data), media, *audio_rows(media, spec)


def audio_features(docs: DataFrame, spec: AudioSpec = AudioSpec()) -> DataFrame:
    """doc_id, text -> the stored WAV, its samples, log-mel tensors with time spans, and energy segments."""

    def run(batches):
        for b in batches:
            for lo in range(0, len(b), 64):
                part = b.iloc[lo : lo + 64]
                n, media, payload, tensors, segments = zip(*_decoded(part["text"], spec), strict=True)
                yield pd.DataFrame({"doc_id": part["doc_id"], "media": media, "payload": payload, "n_bytes": n, "tensors": tensors, "segments": segments, "tensor_arrow": [tensor_bytes([t["tensor"] for t in ts], spec) for ts in tensors]})

    return docs.select("doc_id", "text").mapInPandas(run, AUDIO_SCHEMA)


def audio_digest(docs: DataFrame, spec: AudioSpec = AudioSpec()) -> DataFrame:
    """audio_features folded in the same task to digest columns, so tensors never leave the worker."""

    def run(batches):
        for b in batches:
            rows = []
            for doc_id, (n, media, payload, tensors, segments) in zip(b["doc_id"], _decoded(b["text"], spec), strict=True):
                quant = hashlib.sha256()
                stored = read_tensors(tensor_bytes([t["tensor"] for t in tensors], spec))
                quant.update(np.round(stored * 16).astype("<i2").tobytes())
                feature = f"{sum(t['frames'] for t in tensors)}:{len(tensors)}:{len(segments)}:{quant.hexdigest()[:32]}"
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return docs.select("doc_id", "text").mapInPandas(
        run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    )


def op1_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio_digest(table(spark, sf_dir, "documents"))
