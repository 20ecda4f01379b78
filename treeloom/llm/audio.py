"""Documents as audio: a lossless 8-bit wave file, log-mel tensors and active spans.

A text's UTF-8 bytes, filled with blanks to a positive multiple of 192, are the
samples of a mono 8-bit wave file. The file is read back, resampled by a
polyphase filter, cut into overlapped frames and turned into log-mel energies.
Frames are stored as fixed-shape Arrow tensors (chunks of FRAMES x MELS, the last
one filled with the floor value) with their time spans. Segments of activity come
from the frames' energy by hysteresis: on above one level, off below a lower one.
``columns`` makes the files and tensors; ``digests`` reads them back and sums them up.

Each document is computed alone, in blocks that depend on its own length only, so
equal texts give equal values wherever they run.

Defined cases: a null or empty text is 192 blanks; very long texts are read in
blocks; rows that repeat and a null doc_id pass through; an empty table gives an
empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from treeloom.llm.common import text_slices, texts_of

UNIT = 192
RATE = 16_000
#: Resampling to RATE * UP / DOWN.
UP, DOWN, TAPS = 3, 4, 16
WINDOW, HOP, MELS = 256, 128, 20
#: Seconds from one frame to the next, and of one frame.
STEP, SPAN = HOP * DOWN / (RATE * UP), WINDOW * DOWN / (RATE * UP)
#: Frames to a tensor, and frames computed at one time.
FRAMES, BLOCK = 32, 8192
FLOOR = 1e-6
#: Levels of the segmentation in dB above the mean energy.
ON, OFF = 3.0, 1.0


@dataclass
class Audio:
    """What a text gives. energy: dB of each frame; mel: frames x MELS; spans: (first, last + 1) active frames."""

    n_bytes: int
    media: bytes
    payload: memoryview
    mel: np.ndarray
    energy: np.ndarray
    spans: np.ndarray


def to_wave(payload: bytes, rate: int = RATE) -> bytes:
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(payload))
    return head + payload


def from_wave(media: bytes | pa.Buffer) -> tuple[int, memoryview]:
    """(rate, samples) of a mono 8-bit wave file, whatever other chunks it has."""
    kind, _, form = struct.unpack_from("<4sI4s", media)
    if kind != b"RIFF" or form != b"WAVE":
        raise ValueError("not a wave file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = struct.unpack_from("<4sI", media, at)
        if name == b"fmt ":
            coding, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (coding, channels, bits) != (1, 1, 8):
                raise ValueError("only mono 8-bit samples are read")
        elif name == b"data":
            return rate, memoryview(media)[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no samples")


@lru_cache
def _filter(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed sinc, one row of taps for each of the up phases."""
    n = taps * up
    x = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = np.sinc(x * cut) * cut * up * (0.54 + 0.46 * np.cos(2 * np.pi * x / (n - 1)))
    rows = h.reshape(taps, up).T
    return (rows / rows.sum(1, keepdims=True)).astype(np.float32)


def resampled(x: np.ndarray, up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """x at up / down times its rate: output k is phase k * down % up of the filter at input k * down // up.

    Only outputs that stay are computed, each phase by one strided product.
    """
    h = _filter(up, down, taps)
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.full(taps // 2, x[0], np.float32), x.astype(np.float32), np.full(taps, x[-1], np.float32)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, taps)
    out = np.empty(n, np.float32)
    for first in range(up):
        k = first * down
        at = slice(k // up, None, down)
        got = len(range(first, n, up))
        part = windows[at][:got]
        out[first::up] = np.einsum("ij,j->i", part, h[k % up][::-1])
    return out


@lru_cache
def _mel_weights(rate: float, window: int, mels: int) -> np.ndarray:
    """Triangles evenly spaced on the mel scale over the bins of a real transform."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20.0), mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(window, 1 / rate)[:, None]
    low, mid, high = edges[:-2], edges[1:-1], edges[2:]
    return np.maximum(0, np.minimum((f - low) / (mid - low), (high - f) / (high - mid))).astype(np.float32)


def log_mel(x: np.ndarray, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """(mel, energy) of the frames of x, which has at least one."""
    n = 1 + max(0, -(-(len(x) - WINDOW) // HOP))
    x = np.concatenate([x, np.zeros((n - 1) * HOP + WINDOW - len(x), np.float32)]) if len(x) < (n - 1) * HOP + WINDOW else x
    frames = np.lib.stride_tricks.sliding_window_view(x, WINDOW)[::HOP]
    taper, weights = np.hanning(WINDOW).astype(np.float32), _mel_weights(rate, WINDOW, MELS)
    mel, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for i in range(0, n, BLOCK):
        block = frames[i : min(n, i + BLOCK)]
        power = np.abs(np.fft.rfft(block * taper, axis=1)).astype(np.float32) ** 2
        mel[i : i + BLOCK] = np.log(np.maximum(power @ weights, FLOOR))
        energy[i : i + BLOCK] = 10 * np.log10(np.maximum((block * block).mean(axis=1), FLOOR))
    return mel, energy


def active(energy: np.ndarray, on: float = ON, off: float = OFF) -> np.ndarray:
    """(first, last + 1) of runs that start at or above mean + on and end below mean + off."""
    level = energy - energy.mean()
    mark = np.where(level >= on, 1, np.where(level < off, -1, 0))
    last = np.maximum.accumulate(np.where(mark != 0, np.arange(len(mark)), -1))
    state = np.concatenate([[0], (last >= 0) & (mark[last] == 1), [0]]).astype(np.int8)
    turn = np.flatnonzero(np.diff(state))
    return turn.reshape(-1, 2)


def listen(text: str) -> Audio:
    data = text.encode("utf-8", "surrogatepass")
    media = to_wave(data + b" " * (max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data)))
    rate, payload = from_wave(media)
    x = resampled((np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128)
    mel, energy = log_mel(x, rate * UP / DOWN)
    return Audio(len(data), media, payload, mel, energy, active(energy))


def tensors(audio: Audio) -> pa.Table:
    """Chunks of FRAMES frames, with first frame, frames in use, start and end in seconds, and two fixed-shape tensor columns: mel and energy."""
    n = len(audio.mel)
    chunks = -(-n // FRAMES)
    mel, energy = np.full((chunks * FRAMES, MELS), np.log(FLOOR), np.float32), np.full(chunks * FRAMES, 10 * np.log10(FLOOR), np.float32)
    mel[:n], energy[:n] = audio.mel, audio.energy
    first = np.arange(chunks) * FRAMES
    used = np.minimum(n - first, FRAMES)
    shaped = pa.FixedShapeTensorArray.from_numpy_ndarray
    return pa.table({
        "frame": first, "frames": used, "start": first * STEP, "end": (first + used - 1) * STEP + SPAN,
        "mel": shaped(mel.reshape(chunks, FRAMES, MELS)), "energy": shaped(energy.reshape(chunks, FRAMES)),
    })


def stored(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as w:
        w.write_table(table)
    return sink.getvalue().to_pybytes()


def read_back(features: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(mel, energy) of the frames in use."""
    table = pa.ipc.open_stream(features).read_all()
    n = sum(table["frames"].to_pylist())
    mel, energy = (np.concatenate([c.to_numpy_ndarray() for c in table[k].chunks]) for k in ("mel", "energy"))
    return mel.reshape(-1, MELS)[:n], energy.reshape(-1)[:n]


def feature(mel: np.ndarray, energy: np.ndarray, spans: list[dict]) -> str:
    """A summary of the features: frames, mean energy, active spans in seconds, digest of the mel values at 0.01."""
    said = ",".join(f"{s['start']:.3f}-{s['end']:.3f}" for s in spans)
    steps = np.round(mel * 100).astype("<i4")
    return f"frames={len(mel)};energy={energy.mean():.2f};active={said};mel={hashlib.sha256(steps.tobytes()).hexdigest()[:32]}"


def columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media, features, active): the wave file, the tensors as an Arrow stream, active spans in seconds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, texts in text_slices(batch.column("text")):
                found = [listen(t) for t in texts]
                spans = [[{"start": a * STEP, "end": (b - 1) * STEP + SPAN} for a, b in x.spans.tolist()] for x in found]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_id")[i:j], pa.array([x.n_bytes for x in found], pa.int64()), pa.array([x.media for x in found], pa.binary()),
                        pa.array([stored(tensors(x)) for x in found], pa.binary()), pa.array(spans, pa.list_(pa.struct([("start", pa.float64()), ("end", pa.float64())]))),
                    ],
                    ["doc_id", "n_bytes", "media", "features", "active"],
                )
            pa.default_memory_pool().release_unused()

    kind = docs.schema[id_col].dataType.simpleString()
    return texts_of(docs, id_col, text_col).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary, features binary, active array<struct<start:double,end:double>>")


def digests(rows: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature; rows as ``columns`` gives them.

    Payload and features are read back from the stored files and tensors.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        for batch in batches:
            found = []
            for media, features, spans in zip(*(batch.column(c) for c in ("media", "features", "active")), strict=True):
                file = media.as_buffer()
                _, payload = from_wave(file)
                found.append((len(payload), sha(payload), zlib.crc32(payload[-16:]), file.size, sha(file), feature(*read_back(features.as_buffer()), spans.as_py())))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, k) for c, k in zip(zip(*found, strict=True) if found else [[]] * 6, kinds, strict=True))],
                ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
            )

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
