"""Audio features of media columns.

Samples are stored as 8-bit mono WAV, read back, resampled by a polyphase
filter, and turned into overlapped log-mel frames.  Frames are gathered into
windows of a fixed shape, a fixed-shape Arrow tensor for each document with the
time span of each window, and a hysteresis threshold on the frames' energy
gives the active segments.  Sound is processed in blocks, so that a task's
memory does not follow the length of a recording.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 16_000  #: of stored samples
UP, DOWN = 1, 2  #: resampled to 8 kHz
TAPS = 24  #: filter taps for each phase
FRAME, HOP, MELS = 256, 128, 32
WINDOW = 32  #: frames of a tensor's window
BLOCK = 1 << 16  #: resampled samples worked on at once
HIGH, LOW = 1.25, 0.75  #: hysteresis, times the mean energy
ALIGN = 64


def to_wav(payload: bytes, rate: int = RATE) -> bytes:
    """8-bit mono WAV whose samples are the payload's bytes."""
    pad = b"\0" * (len(payload) & 1)
    head = b"RIFF" + struct.pack("<I", 36 + len(payload) + len(pad)) + b"WAVEfmt "
    return head + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + pad


def from_wav(media: bytes) -> tuple[bytes, int]:
    """(samples, rate) of an 8-bit mono WAV; chunks may stand in any order."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, rate, data = 12, RATE, b""
    while at + 8 <= len(media):
        name, n = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            rate = struct.unpack_from("<I", media, at + 12)[0]
        elif name == b"data":
            data = media[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    return data, rate


@lru_cache(4)
def phases(up: int = UP, down: int = DOWN, taps: int = TAPS) -> np.ndarray:
    """Windowed-sinc low-pass split into ``up`` polyphase branches."""
    n = taps * up
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = np.sinc(t * cut) * cut * np.hamming(n) * up
    return h.reshape(taps, up).T.astype(np.float32)


def resample(x: np.ndarray, up: int = UP, down: int = DOWN) -> np.ndarray:
    """Polyphase rational resampling; only outputs that are kept are computed."""
    h = phases(up, down)
    taps = h.shape[1]
    n = -(-len(x) * up // down)
    padded = np.concatenate([np.zeros(taps - 1, np.float32), x.astype(np.float32), np.zeros(taps, np.float32)])
    out = np.empty(n, np.float32)
    for start in range(up):
        # Outputs start, start + up, ... use one branch, and move `down` inputs each.
        count = len(range(start, n, up))
        branch, first = (start * down) % up, (start * down) // up
        acc = np.zeros(count, np.float32)
        for k in range(taps):
            acc += h[branch][taps - 1 - k] * padded[first + k :: down][:count]
        out[start::up] = acc
    return out


@lru_cache(4)
def mel_bank(rate: int, frame: int = FRAME, mels: int = MELS) -> np.ndarray:
    """Triangular filters, equally spaced on the mel scale."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(20), mel(rate / 2), mels + 2) / 2595) - 1)
    f = np.fft.rfftfreq(frame, 1 / rate)
    up = (f - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    down = (edges[2:, None] - f) / (edges[2:] - edges[1:-1])[:, None]
    return np.maximum(0, np.minimum(up, down)).T.astype(np.float32)


@lru_cache(1)
def _hann() -> np.ndarray:
    return np.hanning(FRAME).astype(np.float32)


def log_mel(payload: bytes, rate: int = RATE) -> np.ndarray:
    """Frames x mels of the whole sound, worked out in blocks.

    Blocks start at multiples of the hop and keep ``FRAME - HOP`` samples of
    the next, so they give the frames that one pass would give.
    """
    raw = np.frombuffer(payload, np.uint8)
    out_rate = rate * UP // DOWN
    bank, hann, rows = mel_bank(out_rate), _hann(), []
    size = BLOCK * DOWN // UP
    margin = TAPS * DOWN
    total = -(-len(raw) * UP // DOWN)
    frames = max(1, -(-max(0, total - FRAME) // HOP) + 1)
    for begin in range(0, max(1, frames * HOP * DOWN // UP), size):
        lo = max(0, begin - margin)
        part = (raw[lo : begin + size + FRAME * DOWN // UP + margin].astype(np.float32) - 128) / 128
        y = resample(part)[(begin - lo) * UP // DOWN :]
        n = min(BLOCK // HOP, frames - begin * UP // DOWN // HOP)
        if n <= 0:
            break
        y = np.concatenate([y, np.zeros(max(0, (n - 1) * HOP + FRAME - len(y)), np.float32)])
        cut = np.lib.stride_tricks.sliding_window_view(y, FRAME)[:: HOP][:n] * hann
        power = np.abs(np.fft.rfft(cut, axis=1)).astype(np.float32) ** 2
        rows.append(np.log10(power @ bank + 1e-6))
    return np.concatenate(rows)


def segments(energy: np.ndarray, high: float = HIGH, low: float = LOW) -> list[tuple[int, int]]:
    """Frame ranges that reach ``high`` times the mean and stay over ``low``."""
    mean = float(energy.mean())
    on, hot = energy > low * mean, energy > high * mean
    edge = np.flatnonzero(np.diff(np.r_[False, on, False].astype(np.int8)))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True) if hot[a:b].any()]


def tensor(mel: np.ndarray) -> tuple[pa.FixedShapeTensorArray, list[tuple[float, float]]]:
    """Windows as a fixed-shape Arrow tensor array, and their time spans in s."""
    n = -(-len(mel) // WINDOW)
    full = np.full((n * WINDOW, mel.shape[1]), -6.0, np.float32)
    full[: len(mel)] = mel
    array = pa.FixedShapeTensorArray.from_numpy_ndarray(full.reshape(n, WINDOW, mel.shape[1]))
    step = HOP * DOWN / UP / RATE
    return array, [(i * WINDOW * step, min(len(mel), (i + 1) * WINDOW) * step) for i in range(n)]


def tensor_bytes(array: pa.FixedShapeTensorArray) -> bytes:
    """Arrow IPC stream of a tensor column (its type keeps the shape)."""
    sink = io.BytesIO()
    batch = pa.RecordBatch.from_arrays([array], ["mel"])
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue()


COLUMNS = (
    "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "tensors_sha256 string, media binary, tensors binary, windows array<struct<start_s: double, end_s: double>>, segments array<struct<start_s: double, end_s: double>>"
)
DIGESTS = tuple(c.split()[0] for c in COLUMNS.split(", ")[:7])


def audio(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_media: bool = True) -> DataFrame:
    """Stored sound, its digests and its features for every row.

    The text's UTF-8 bytes with zeros up to a positive multiple of 64 are the
    samples (null: empty).  The windows' time spans, the active segments and the
    digest of the Arrow tensors are returned for every row; ``keep_media`` says
    whether the WAV and the tensors themselves are too, else they are null.
    Equal texts give equal values; no rows give none; other columns are
    not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = HOP * DOWN / UP / RATE
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b, rows = whole.slice(at, 64), []
                for text in b.column("text").to_pylist():
                    raw = (text or "").encode("utf-8")
                    payload = raw + b"\0" * (-len(raw) % ALIGN or (0 if raw else ALIGN))
                    media = to_wav(payload)
                    back, rate = from_wav(media)
                    mel = log_mel(back, rate)
                    active = segments(np.exp(mel * np.float32(np.log(10))).sum(axis=1))
                    array, spans = tensor(mel)
                    ipc = tensor_bytes(array)
                    values = np.round(mel.mean(axis=0, dtype=np.float64), 4) + 0.0
                    feature = f"frames={len(mel)};windows={-(-len(mel) // WINDOW)};segments={len(active)};active={sum(y - x for x, y in active)};mel={zlib.crc32(values.astype('<f8').tobytes()):08x}"
                    rows.append((
                        len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-ALIGN:]), len(media), hashlib.sha256(media).hexdigest(), feature,
                        hashlib.sha256(ipc).hexdigest(), *((media, ipc) if keep_media else (None, None)),
                        [{"start_s": x, "end_s": y} for x, y in spans], [{"start_s": x * step, "end_s": y * step} for x, y in active],
                    ))
                span = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.binary(), span, span]
                names = [c.split()[0] for c in COLUMNS.split(", ")[:7]] + ["tensors_sha256", "media", "tensors", "windows", "segments"]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], ["doc_id", *names])

    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id long, {COLUMNS}")
