"""Audio features: polyphase resampling, overlapped log-mel frames, hysteresis segments of energy, with time spans.

A media column holds WAV files (8-bit PCM, one channel). Features are worked out in blocks of bounded length, one row at a
time, within the task that reads the row. Media and clips (tensors with their time spans) are stored tables; summaries read both
back, and only what clips sum up to is shuffled.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from calltide.llm.common import Stored

UNIT, PAD, TAIL = 576, 255, 32
#: Clips in a batch, unless one file has more.
BATCH_CLIPS = 128


@dataclass(frozen=True)
class AudioConfig:
    rate: int = 24_000
    up: int = 2
    down: int = 3
    taps: int = 16  # of each phase
    frame: int = 400
    hop: int = 160
    fft: int = 512
    mels: int = 32
    clip_frames: int = 96  # frames of a tensor
    on_db: float = 1.0  # over the median energy: a segment begins
    off_db: float = -1.0  # under it: the segment ends
    block: int = 1 << 16  # input samples at a time, rounded to whole periods of the resampler

    @property
    def out_rate(self) -> int:
        return self.rate * self.up // self.down


def to_wav(samples: bytes, rate: int) -> bytes:
    """A RIFF/WAVE file of 8-bit unsigned mono PCM; odd data get the pad byte that RIFF asks for."""
    pad = b"\0" * (len(samples) % 2)
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + len(pad), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples + pad


def from_wav(media: bytes) -> tuple[memoryview, int]:
    """The samples of a file's data chunk, and its rate; other chunks are passed over."""
    if len(media) < 12 or media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a WAVE file")
    at, rate = 12, 0
    while at + 8 <= len(media):
        name, size = media[at : at + 4], int.from_bytes(media[at + 4 : at + 8], "little")
        if name == b"fmt ":
            form, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", media, at + 8)
            if (form, channels, bits) != (1, 1, 8):
                raise ValueError(f"8-bit mono PCM is wanted, this has form {form}, {channels} channels, {bits} bits")
        elif name == b"data":
            return memoryview(media)[at + 8 : at + 8 + size], rate
        at += 8 + size + size % 2
    raise ValueError("the file has no data chunk")


@lru_cache(maxsize=8)
def phases(up: int, down: int, taps: int) -> np.ndarray:
    """A windowed-sinc low-pass split by phase: row p weighs ``taps`` samples for outputs ``p / up`` of a sample past the newest."""
    n = up * taps
    t = np.arange(n) - (n - 1) / 2
    cut = 1 / max(up, down)
    h = np.sinc(t * cut) * cut * np.hamming(n)
    rows = h.reshape(taps, up).T[:, ::-1]  # oldest sample first
    return np.ascontiguousarray(rows / rows.sum(axis=1, keepdims=True), np.float32)


def resample(x: np.ndarray, c: AudioConfig) -> np.ndarray:
    """Output m is phase (m * down) % up over the samples that end at (m * down) // up; samples before the first are 0."""
    bank, n_out = phases(c.up, c.down, c.taps), -(-len(x) * c.up // c.down)
    out = np.zeros(n_out, np.float32)
    padded = np.concatenate([np.zeros(c.taps - 1, np.float32), x])
    windows = np.lib.stride_tricks.sliding_window_view(padded, c.taps)
    for k in range(c.up):  # outputs k, k + up, ...: one phase each, every ``down``-th window
        at, phase = k * c.down // c.up, k * c.down % c.up
        got = windows[at :: c.down] @ bank[phase]
        m = min(len(got), len(out[k :: c.up]))
        out[k : k + m * c.up : c.up] = got[:m]
    return out


@lru_cache(maxsize=8)
def mel_bank(rate: int, fft: int, mels: int) -> np.ndarray:
    hz = 700 * (10 ** (np.linspace(0, 2595 * np.log10(1 + rate / 2 / 700), mels + 2) / 2595) - 1)
    bins = np.arange(fft // 2 + 1) * rate / fft
    up = (bins[:, None] - hz[None, :-2]) / (hz[1:-1] - hz[:-2])
    down = (hz[None, 2:] - bins[:, None]) / (hz[2:] - hz[1:-1])
    return np.maximum(0, np.minimum(up, down)).astype(np.float32)


def log_mel(y: np.ndarray, c: AudioConfig) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows (frames x mels) and log energies (dB) of overlapped Hann frames; a signal under one frame is padded to one."""
    if len(y) < c.frame:
        y = np.pad(y, (0, c.frame - len(y)))
    frames = np.lib.stride_tricks.sliding_window_view(y, c.frame)[:: c.hop]
    window = np.hanning(c.frame).astype(np.float32)
    bank = mel_bank(c.out_rate, c.fft, c.mels)
    mels, energy = [], []
    for i in range(0, len(frames), 512):
        part = frames[i : i + 512] * window
        spectrum = np.fft.rfft(part, c.fft)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mels.append(np.log(power @ bank + np.float32(1e-6)))
        energy.append(10 * np.log10((part * part).mean(axis=1) + np.float32(1e-9)))
    return np.concatenate(mels), np.concatenate(energy)


def segments(energy: np.ndarray, c: AudioConfig) -> list[tuple[int, int]]:
    """Frames [first, end) where the state is on: it goes on over the upper threshold, off under the lower, and holds between."""
    level = np.median(energy)
    event = np.where(energy > level + c.on_db, 1, np.where(energy < level + c.off_db, 2, 0))
    last = np.maximum.accumulate(np.where(event > 0, np.arange(len(event)), -1))
    on = np.concatenate([[False], (last >= 0) & (event[np.maximum(last, 0)] == 1), [False]])
    edge = np.flatnonzero(on[1:] != on[:-1])
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def features(samples: memoryview | bytes, c: AudioConfig) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel rows and energies of 8-bit samples, worked out block by block with the overlap that filters and frames need."""
    raw = np.frombuffer(samples, np.uint8)
    step, parts, rest = max(1, c.block // c.down) * c.down, [], np.zeros(0, np.float32)
    mels, energy = [], []
    history = -(-c.taps // c.down) * c.down  # samples kept before a block: whole periods, so phases stay
    for at in range(0, max(1, len(raw)), step):
        low = max(0, at - history)
        x = (raw[low : at + step].astype(np.float32) - 128) / 128
        rest = np.concatenate([rest, resample(x, c)[(at - low) * c.up // c.down :]])
        whole = (len(rest) - c.frame) // c.hop + 1
        if at + step >= len(raw):
            parts.append(rest) if len(rest) >= c.frame or not mels else None
        elif whole > 0:
            parts.append(rest[: (whole - 1) * c.hop + c.frame])
            rest = rest[whole * c.hop :]
        for part in parts:
            m, e = log_mel(part, c)
            mels.append(m), energy.append(e)
        parts = []
    return np.concatenate(mels), np.concatenate(energy)


def clips(mels: np.ndarray, c: AudioConfig) -> Iterator[tuple[int, np.ndarray]]:
    """Fixed-shape tensors (clip_frames x mels) and their valid frames; the last is filled with zeros."""
    for at in range(0, len(mels), c.clip_frames):
        part = mels[at : at + c.clip_frames]
        full = np.zeros((c.clip_frames, c.mels), np.float32)
        full[: len(part)] = part
        yield len(part), full


def tensor_column(stored: pa.Array | pa.ChunkedArray, c: AudioConfig = AudioConfig()) -> pa.FixedShapeTensorArray:
    """The ``tensor`` column of :func:`audio_clips` as Arrow's fixed-shape tensor type, over the stored bytes themselves, without a copy."""
    stored = stored.combine_chunks() if isinstance(stored, pa.ChunkedArray) else stored
    width, n = c.clip_frames * c.mels, len(stored)
    offsets = np.frombuffer(stored.buffers()[1], np.int64 if pa.types.is_large_binary(stored.type) else np.int32)[stored.offset : stored.offset + n + 1] if n else np.zeros(1, np.int64)
    if stored.null_count or (np.diff(offsets) != 4 * width).any():
        raise ValueError(f"each clip has {width} values of 4 bytes")
    values = np.frombuffer(stored.buffers()[2], np.float32, n * width, int(offsets[0])) if n else np.zeros(0, np.float32)
    storage = pa.FixedSizeListArray.from_arrays(pa.array(values), width)
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), (c.clip_frames, c.mels)), storage)


def tensor_bytes(tensors: pa.FixedShapeTensorArray) -> pa.Array:
    """A fixed-shape tensor column as a binary one over the same memory, which is what Spark's files can hold."""
    values, width = tensors.storage.flatten(), 4 * tensors.storage.type.list_size
    offsets = np.arange(len(tensors) + 1, dtype=np.int64) * width
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(tensors), [None, pa.py_buffer(offsets), values.buffers()[1]]).cast(pa.binary())


def _clips(batches: Iterator[pa.RecordBatch], c: AudioConfig, facts: bool) -> Iterator[pa.RecordBatch]:
    hop, kind = c.hop / c.out_rate, pa.fixed_shape_tensor(pa.float32(), (c.clip_frames, c.mels))
    names = ["id", "clip", "start_s", "end_s", "n_frames", "tensor", "segments", *(["n_clips", "facts"] if facts else [])]
    for batch in batches:
        of, number, first, valid, tensors, inside, counts, read = [], [], [], [], [], [], [], []
        for i, media in enumerate(batch.column("media")):
            if media.is_valid:
                stored = media.as_py()
                samples, _ = from_wav(stored)
                mels, energy = features(samples, c)
                spans, made = segments(energy, c), list(clips(mels, c))
                for k, (v, tensor) in enumerate(made):
                    f = k * c.clip_frames
                    of.append(i), number.append(k), first.append(f), valid.append(v), tensors.append(tensor.ravel())
                    inside.append([{"start_s": max(a, f) * hop, "end_s": min(b, f + v) * hop} for a, b in spans if a < f + v and b > f])
                    counts.append(len(made)), read.append(stored_facts(stored, samples) if facts and not k else None)
            if of and (len(of) >= BATCH_CLIPS or i + 1 == batch.num_rows):
                start, frames = np.asarray(first), np.asarray(valid)
                column = pa.ExtensionArray.from_storage(kind, pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate(tensors)), c.clip_frames * c.mels))
                columns = [
                    batch.column("id").take(pa.array(of, pa.int64())), pa.array(number, pa.int32()), pa.array(start * hop), pa.array((start + frames) * hop), pa.array(frames.astype(np.int32)), tensor_bytes(column),
                    pa.array(inside, pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))), *([pa.array(counts, pa.int32()), pa.array(read, FACTS)] if facts else []),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                of, number, first, valid, tensors, inside, counts, read = [], [], [], [], [], [], [], []


FACTS = pa.struct([("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string())])
_FACTS = "struct<payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string>"
_SPANS = "array<struct<start_s:double,end_s:double>>"


def stored_facts(stored: bytes, samples: memoryview) -> dict:
    """Sizes and digests of a file as it was read, and of its samples."""
    return {"payload_bytes": len(samples), "payload_sha256": hashlib.sha256(samples).hexdigest(), "tail_crc32": zlib.crc32(samples[-TAIL:]), "media_bytes": len(stored), "media_sha256": hashlib.sha256(stored).hexdigest()}


def audio_clips(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", config: AudioConfig = AudioConfig(), facts: bool = False) -> DataFrame:
    """A row for each clip of each WAV file: ``id_col``, clip, start_s, end_s, n_frames, tensor, segments.

    ``tensor`` holds the bytes of a fixed-shape Arrow tensor (clip_frames x mels of float32, row by row); Spark has no type for
    these, so :func:`tensor_column` gives the tensor type back. Frames over ``n_frames`` are zeros. With ``facts`` there are
    n_clips, too, and in each file's first clip what :func:`stored_facts` says of the bytes that were read.

    Null media give no rows; a file with fewer samples than one frame gives one clip of one frame. Files that aren't 8-bit mono
    PCM fail the task with what was found instead. Repeated rows are worked out each; other columns aren't read.
    """
    kind = media.select(id_col).dtypes[0][1]
    rows = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    more = f", n_clips int, facts {_FACTS}" if facts else ""
    out = rows.mapInArrow(partial(_clips, c=config, facts=facts), f"id {kind}, clip int, start_s double, end_s double, n_frames int, tensor binary, segments {_SPANS}{more}")
    return out.withColumnRenamed("id", id_col)


def padded_payload(text: str | bytes) -> bytes:
    data = text.encode() if isinstance(text, str) else text
    return data + bytes([PAD]) * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", config: AudioConfig = AudioConfig()) -> DataFrame:
    """``id_col`` and a media column: each text's UTF-8 bytes, padded, as the samples of a WAV file (null: an empty text)."""
    kind = docs.select(id_col).dtypes[0][1]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                data = [t.encode() for t in part.column("text").to_pylist()]
                sizes = pa.array([len(d) for d in data], pa.int64())
                media = pa.array([to_wav(padded_payload(d), config.rate) for d in data], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("id"), sizes, media], names=["id", "n_bytes", "media"])

    return rows.mapInArrow(wrap, f"id {kind}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


def feature_text(parts: list[dict], c: AudioConfig) -> str:
    """Frames, mean of each mel band, a digest of all clip tensors, and all time spans, of a file's clips as :func:`clip_parts` has them."""
    parts = sorted(parts, key=lambda p: p["clip"])
    frames, total, spans = sum(p["n_frames"] for p in parts), np.zeros(c.mels), []
    for p in parts:
        total += p["sums"]
        for s in p["segments"]:
            if spans and abs(spans[-1][1] - s["start_s"]) < c.hop / c.out_rate / 2:  # it goes on over the border of two clips
                spans[-1][1] = s["end_s"]
            else:
                spans.append([s["start_s"], s["end_s"]])
    digest = hashlib.sha256(b"".join(p["digest"] for p in parts)).hexdigest()
    means = ",".join(f"{v:.3f}" for v in total / max(frames, 1))
    return f"frames={frames};mel={means};tensors={digest};segments={','.join(f'{a:.2f}-{b:.2f}' for a, b in spans)}"


def clip_parts(batches: Iterator[pa.RecordBatch], c: AudioConfig) -> Iterator[pa.RecordBatch]:
    """For each stored clip, what its file's feature string takes from it: digest and band sums of its tensor, and its spans."""
    for batch in batches:
        tensors = tensor_column(batch.column("tensor"), c).to_numpy_ndarray() if batch.num_rows else np.zeros((0, c.clip_frames, c.mels), np.float32)
        digests = pa.array([hashlib.sha256(np.ascontiguousarray(t)).digest() for t in tensors], pa.binary())
        sums = pa.array(tensors.sum(axis=1, dtype=np.float64).tolist(), pa.list_(pa.float64()))  # frames that fill up are 0
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in ("key", "facts", "clip", "n_frames")), digests, sums, batch.column("segments")], names=["key", "facts", *PART])


PART = ["clip", "n_frames", "digest", "sums", "segments"]


def _described(batches: Iterator[pa.RecordBatch], c: AudioConfig) -> Iterator[pa.RecordBatch]:
    """The feature string of each file from the parts of its clips."""
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("facts"), pa.array([feature_text(p, c) for p in batch.column("parts").to_pylist()], pa.string())], names=["key", "facts", "feature"])


def _described_alone(batches: Iterator[pa.RecordBatch], c: AudioConfig) -> Iterator[pa.RecordBatch]:
    """The same for files of one clip, which need no grouping."""
    for part in clip_parts(batches, c):
        yield pa.RecordBatch.from_arrays([part.column("key"), part.column("facts"), pa.array([feature_text([p], c) for p in part.select(PART).to_pylist()], pa.string())], names=["key", "facts", "feature"])


def store_clips(media: DataFrame, id_col: str = "doc_id", config: AudioConfig = AudioConfig()) -> tuple[DataFrame, DataFrame]:
    """The stored media, each row with a number of its own (``row``), and the stored clips of all of them, made from what was stored."""
    kept = Stored(media.sparkSession, "media")
    stored = kept.write(media.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), "n_bytes", "media"), "media")
    made = audio_clips(stored.select(F.struct("row", "id", "n_bytes").alias("key"), "media"), "key", config=config, facts=True)
    return stored, kept.write(made.withColumn(id_col, F.col("key.id")), "clips")


def media_summary(media: DataFrame, id_col: str = "doc_id", config: AudioConfig = AudioConfig()) -> DataFrame:
    """What :func:`text_media` gives, stored, read back, cut to stored clips, and those read back: sizes, digests and a feature
    string for each row (see :func:`feature_text`). Only clips of files that have several are shuffled.
    """
    kind = media.select(id_col).dtypes[0][1]
    _, cut = store_clips(media, id_col, config)
    key = f"key struct<row:bigint,id:{kind},n_bytes:bigint>"
    clip = cut.select("key", "clip", "n_frames", "tensor", "segments", "n_clips", "facts")
    described = f"{key}, facts {_FACTS}, feature string"
    alone = clip.where("n_clips = 1").mapInArrow(partial(_described_alone, c=config), described)
    parts = clip.where("n_clips > 1").mapInArrow(partial(clip_parts, c=config), f"{key}, facts {_FACTS}, clip int, n_frames int, digest binary, sums array<double>, segments {_SPANS}")
    grouped = parts.groupBy("key").agg(F.max("facts").alias("facts"), F.collect_list(F.struct(*PART)).alias("parts"))  # a file's clips
    out = alone.unionByName(grouped.mapInArrow(partial(_described, c=config), described))
    return out.select(F.col("key.id").alias(id_col), "key.n_bytes", "facts.*", "feature")
