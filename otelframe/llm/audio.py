"""Audio as a media column: lossless 8-bit WAV, log-mel tensors, energy segments.

``store_media`` keeps each payload as a WAV file (8-bit unsigned mono) in a binary
column of a Parquet table. ``features`` reads the stored bytes: a polyphase filter
resamples them, overlapped frames go through a mel filterbank and a logarithm, and
frame energy is cut into segments by two thresholds (a segment starts above the
upper one and ends below the lower one). Frames are kept as patches of one fixed
shape in an Arrow ``fixed_shape_tensor`` column with the time span of each patch: an
Arrow stream for each recording, stored in a Parquet table, from which ``described``
reads what it tells of them.
"""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from otelframe.llm.common import documents, map_texts, materialize

#: Sample rates stored and analysed: a polyphase filter of UP phases, TAPS taps each.
RATE, UP, DOWN, TAPS = 8000, 3, 4, 12
FRAME, HOP, MELS, PATCH = 256, 128, 20, 32
#: Energy in dB above the median of the recording: a segment starts and ends here.
START_DB, END_DB = 1.5, 0.5
#: Samples that are analysed at a time (bounds memory for very long recordings).
BLOCK = 1 << 20
PAYLOAD_UNIT = 192


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """An 8-bit mono PCM file; payloads have even length, so no pad byte follows."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def from_wav(data: bytes) -> tuple[int, bytes]:
    """Sample rate and samples; walks the chunks, so other chunks may precede them."""
    if data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate = 12, 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from("<4sI", data, at)
        if kind == b"fmt ":
            code, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, at + 8)
            if (code, channels, bits) != (1, 1, 8):
                raise ValueError("not 8-bit mono PCM")
        elif kind == b"data":
            return rate, data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@functools.lru_cache(maxsize=1)
def phases() -> np.ndarray:
    """Windowed-sinc low pass, split into UP phases: phases[p, t]."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / max(UP, DOWN)) * np.kaiser(n, 6.0)
    h *= UP / h.sum()
    return np.ascontiguousarray(h.reshape(TAPS, UP).T[:, ::-1], dtype=np.float32)


def resample(x: np.ndarray) -> np.ndarray:
    """``x`` at UP / DOWN of its rate: output m is phase (m DOWN) mod UP of the filter
    at input position (m DOWN) div UP."""
    padded = np.concatenate((np.zeros(TAPS - 1, np.float32), x.astype(np.float32)))
    windows = np.lib.stride_tricks.sliding_window_view(padded, TAPS)
    m = np.arange(-(-len(x) * UP // DOWN))
    out, h = np.empty(len(m), np.float32), phases()
    for first in range(UP):  # outputs with one phase are DOWN inputs apart
        mine = slice(first, None, UP)
        place = first * DOWN // UP
        rows = windows[place::DOWN][: len(m[mine])]
        out[mine] = rows @ h[first * DOWN % UP]
    return out


@functools.lru_cache(maxsize=1)
def mel_filters() -> np.ndarray:
    """Triangles evenly spaced on the mel scale up to half the analysed rate."""
    top = RATE * UP / DOWN / 2
    mel = np.linspace(0, 2595 * np.log10(1 + top / 700), MELS + 2)
    edges = 700 * (10 ** (mel / 2595) - 1)
    hz = np.linspace(0, top, FRAME // 2 + 1)
    rise = (hz[:, None] - edges[None, :-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[None, 2:] - hz[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel frames [n, MELS] (float32) and frame energies in dB; the end is padded
    with zeros to a whole number of hops, and there is one frame at least."""
    frames = max(1, 1 + -(-(len(x) - FRAME) // HOP))
    x = np.concatenate((x, np.zeros(max(0, (frames - 1) * HOP + FRAME - len(x)), np.float32)))
    windows = np.lib.stride_tricks.sliding_window_view(x, FRAME)[::HOP][:frames]
    hann = np.hanning(FRAME).astype(np.float32)
    mels, energy = np.empty((frames, MELS), np.float32), np.empty(frames, np.float32)
    for a in range(0, frames, BLOCK // HOP):
        part = windows[a : a + BLOCK // HOP] * hann
        power = np.abs(np.fft.rfft(part, axis=1)).astype(np.float32) ** 2
        mels[a : a + len(part)] = np.log(power @ mel_filters() + 1e-6)
        energy[a : a + len(part)] = 10 * np.log10((part * part).mean(axis=1) + 1e-9)
    return mels, energy


def segments(energy: np.ndarray) -> list[tuple[int, int]]:
    """[first, last + 1) frames of each segment, by hysteresis around the median."""
    level = energy - np.median(energy)
    mark = np.where(level >= START_DB, 1, np.where(level <= END_DB, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    on = np.where(last >= 0, mark[last] == 1, False).astype(np.int8)
    edges = np.flatnonzero(np.diff(np.concatenate(([0], on, [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def tensors(mels: np.ndarray) -> pa.RecordBatch:
    """Patches [PATCH, MELS] of half floats as an Arrow fixed-shape tensor column,
    with start_ms and end_ms; the last patch is padded with its last frame."""
    n = -(-len(mels) // PATCH)
    whole = np.concatenate((mels, np.repeat(mels[-1:], n * PATCH - len(mels), axis=0))).astype(np.float16).reshape(n, PATCH * MELS)
    kind = pa.fixed_shape_tensor(pa.float16(), [PATCH, MELS], dim_names=["frame", "mel"])
    flat = pa.FixedSizeListArray.from_arrays(pa.array(whole.reshape(-1)), PATCH * MELS)
    ms = 1000 * HOP * DOWN / (RATE * UP)
    starts = np.arange(n) * PATCH * ms
    ends = np.minimum((np.arange(n) + 1) * PATCH, len(mels)) * ms
    return pa.record_batch([pa.ExtensionArray.from_storage(kind, flat), pa.array(starts), pa.array(ends)], names=["log_mel", "start_ms", "end_ms"])


def ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def store_media(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's UTF-8 bytes, filled up with spaces to a
    positive multiple of 192, as a WAV file; written to the shared folder and read
    back. Null texts are empty; repeated rows and null ids are rows like any other;
    other columns are not read."""

    def rows(batch: dict) -> dict:
        raw = [(t or "").encode() for t in batch["text"]]
        return {"doc_id": batch["id"], "n_bytes": [len(r) for r in raw], "media": [to_wav(r + b" " * ((-len(r)) % PAYLOAD_UNIT or (0 if r else PAYLOAD_UNIT))) for r in raw]}

    return materialize(map_texts(docs, [F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text")], "doc_id long, n_bytes long, media binary", rows))


def patches(stream: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The tensors [n, PATCH, MELS] of a stored stream, with start_ms and end_ms."""
    with pa.ipc.open_stream(stream) as reader:
        batch = reader.read_all().combine_chunks()
    column = batch.column("log_mel").chunk(0)
    if column.type.shape != [PATCH, MELS]:
        raise ValueError(f"patches of shape {column.type.shape}")
    return column.to_numpy_ndarray(), batch.column("start_ms").to_numpy(), batch.column("end_ms").to_numpy()


def features(media: DataFrame) -> DataFrame:
    """Of each stored recording: doc_id, n_bytes, payload and file digests,
    segment_start_ms and segment_end_ms, and tensors (an Arrow stream with the fixed-shape
    patches and their spans). Recordings without loud frames have no segments; a recording
    shorter than a frame is one frame; repeated rows and null ids are rows like any other.
    An empty table gives an empty result."""
    ddl = (
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
        "segment_start_ms array<double>, segment_end_ms array<double>, tensors binary"
    )
    ms = 1000 * HOP * DOWN / (RATE * UP)

    def rows(batch: dict) -> dict:
        out: dict[str, list] = {p.split()[0]: [] for p in ddl.split(", ")}
        for doc, n, data in zip(batch["doc_id"], batch["n_bytes"], batch["media"]):
            _, payload = from_wav(data)
            x = (np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128
            mels, energy = log_mel(resample(x))
            found = segments(energy)
            for k, v in zip(out, (
                doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(),
                [a * ms for a, _ in found], [b * ms for _, b in found], ipc(tensors(mels)),
            )):
                out[k].append(v)
        return out

    return map_texts(media, ["doc_id", "n_bytes", "media"], ddl, rows)


def described(stored: DataFrame) -> DataFrame:
    """``stored`` rows of ``features`` with ``feature``, a short text of what the stored
    tensors, spans and segments hold, in place of these."""
    ms = 1000 * HOP * DOWN / (RATE * UP)
    columns = ["tensors", "segment_start_ms", "segment_end_ms"]
    keep = [c for c in stored.columns if c not in columns]

    def rows(batch: dict) -> dict:
        out = []
        for stream, starts, ends in zip(*(batch[c] for c in columns)):
            cubes, first, last = patches(stream)
            frames = round((last[-1] - first[0]) / ms)
            spectrum = ",".join(f"{v:.2f}" for v in cubes.reshape(-1, MELS)[:frames].mean(axis=0, dtype=np.float64))
            loud = round(sum(b - a for a, b in zip(starts, ends)) / ms)
            out.append(f"frames={frames};patches={len(cubes)};segments={len(starts)};loud={loud};mel={spectrum};crc={zlib.crc32(cubes.tobytes())}")
        return {"feature": out}

    return map_texts(stored, [*keep, *columns], "feature string", rows, keep=tuple(keep))


def op5_audio_features(spark, sf_dir: str) -> DataFrame:
    media = store_media(documents(spark, sf_dir))
    done = described(materialize(features(media)))
    return done.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
