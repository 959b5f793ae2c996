"""Media columns: chroma audio fingerprints and their alignment.

A recording (WAV bytes, PCM, mixed to mono) becomes frames of a windowed FFT whose energy is folded into twelve pitch classes. Over
the integral image of frames by pitch classes, sixteen filters compare rectangles and give two Gray-coded bits each: one 32-bit integer a position.
Recordings with equal fingerprints collapse into a class. Equal integers of a query class and another class
vote for the offset between them; an offset with ``VOTES`` votes is aligned, and its bit error over the whole overlap decides.

Silent positions, where a filter window holds no energy at all, carry no pitch and vote for nothing. Queries are the classes that hold
a query recording; they meet all classes through a join on the integers, and pairs are reported between
classes with their members apart, so copies are never expanded into pairs.

Defined cases: null or undecodable bytes and recordings shorter than one window have an empty fingerprint, are members of no class (null)
and match nothing; repeated rows are members each; rows without an id are left out; a class never matches itself; an empty table gives an empty result.
"""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumist.runtime import materialize

RATE, FRAME, HOP = 4000, 1024, 512
LOWEST, HIGHEST = 65.0, 1900.0
#: Each of sixteen filters, by rule: kind, first pitch class, pitch classes, frames.
FILTERS = [(i % 4, (5 * i) % 12, 2 + (3 * i) % 5, 4 + 3 * (i % 3)) for i in range(16)]
WINDOW = max(w for *_, w in FILTERS)
CUTS = (-0.35, 0.0, 0.35)
VOTES, LEAST_OVERLAP, MOST_ERROR = 3, 16, 0.2


def pcm(raw: bytes | None) -> tuple[np.ndarray, int]:
    """Samples in [-1, 1], mono, and their rate; nothing if the bytes are no PCM recording."""
    try:
        with wave.open(io.BytesIO(raw or b"")) as w:
            width, channels, rate, data = w.getsampwidth(), w.getnchannels(), w.getframerate(), w.readframes(w.getnframes())
        kind = {1: np.uint8, 2: np.dtype("<i2"), 4: np.dtype("<i4")}[width]
        x = np.frombuffer(data[: len(data) // (width * channels) * width * channels], kind).reshape(-1, channels).astype(np.float64).mean(axis=1)
        return (x - 128) / 128 if width == 1 else x / 2.0 ** (8 * width - 1), rate
    except (wave.Error, EOFError, KeyError, ValueError, ZeroDivisionError):
        return np.empty(0), RATE


def chroma(samples: np.ndarray, rate: int) -> np.ndarray:
    """(frames, 12) energies of pitch classes, each frame scaled to sum 1 (silent frames stay 0)."""
    frame, hop = max(2, round(FRAME * rate / RATE)), max(1, round(HOP * rate / RATE))
    if len(samples) < frame:
        return np.empty((0, 12))
    frequency = np.fft.rfftfreq(frame, 1 / rate)
    use = (frequency >= LOWEST) & (frequency <= HIGHEST)
    fold = np.zeros((int(use.sum()), 12))
    fold[np.arange(len(fold)), np.rint(12 * np.log2(frequency[use] / 440)).astype(int) % 12] = 1
    views, shape = np.lib.stride_tricks.sliding_window_view(samples, frame)[::hop], np.hanning(frame)
    parts = []
    for at in range(0, len(views), 2048):
        energy = np.abs(np.fft.rfft(views[at : at + 2048] * shape)[:, use]) ** 2 @ fold
        total = energy.sum(axis=1, keepdims=True)
        parts.append(np.where(total > 1e-9, energy / np.maximum(total, 1e-9), 0.0))
    return np.concatenate(parts)


def fingerprint(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed integers of every position, and which positions are not silent."""
    n = len(image) - WINDOW + 1
    if n < 1:
        return np.empty(0, np.int64), np.empty(0, bool)
    wide = np.hstack([image, image])  # pitch classes go round
    area = np.zeros((len(wide) + 1, 25))
    area[1:, 1:] = wide.cumsum(axis=0).cumsum(axis=1)
    at = np.arange(n)

    def box(t0: int, t1: int, p0: int, p1: int) -> np.ndarray:
        return area[at + t1, p1] - area[at + t0, p1] - area[at + t1, p0] + area[at + t0, p0]

    out = np.zeros(n, np.int64)
    for kind, p, h, w in FILTERS:
        whole, half, mid = box(0, w, p, p + h), w // 2, p + h // 2
        if kind == 0:
            a, b = whole, box(0, w, p + h, p + 2 * h)
        elif kind == 1:
            a, b = box(0, half, p, p + h), box(w - half, w, p, p + h)
        elif kind == 2:
            a, b = box(0, half, p, mid) + box(half, w, mid, p + h), box(half, w, p, mid) + box(0, half, mid, p + h)
        else:
            third = max(1, w // 3)
            a = box(third, w - third, p, p + h)
            b = (whole - a) / 2
        level = np.searchsorted(CUTS, np.log((0.02 + a) / (0.02 + b)) + 1e-9)
        out = out << 2 | (level ^ (level >> 1))
    return out, box(0, WINDOW, 0, 12) > 0


def fingerprints(recordings: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """Per recording with an id: id, print (array of integers), sounding (array of booleans)."""
    fields = [T.StructField("id", T.LongType()), T.StructField("print", T.ArrayType(T.LongType())), T.StructField("sounding", T.ArrayType(T.BooleanType()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                both = [fingerprint(chroma(*pcm(x.as_py()))) for x in part.column(1)]
                ends = pa.array(np.concatenate([[0], np.cumsum([len(p) for p, _ in both])]), pa.int32())
                values = [pa.array(np.concatenate([b[i] for b in both])) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.ListArray.from_arrays(ends, v) for v in values)], names=[f.name for f in fields])

    return recordings.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(media_col).alias("media")).mapInArrow(run, T.StructType(fields))


def align(prints: DataFrame, is_query: Column, votes: int = VOTES, most_error: float = MOST_ERROR) -> tuple[DataFrame, DataFrame]:
    """Members (id, class_id) and matches (query_class, class_id, offset, overlap, bit_error), one row for each pair of classes at its best offset.

    offset: position in the class minus position in the query class.
    """
    prints = materialize(prints.withColumn("q", is_query).withColumn("key", F.struct(F.size("print").alias("n"), F.xxhash64("print").alias("a"), F.xxhash64(F.lit(7), F.reverse("print")).alias("b"))), "media-prints")
    heard = prints.filter("size(print) > 0")
    classes = heard.groupBy("key").agg(F.min("id").alias("cid"), F.max("q").alias("q"), F.min_by(F.struct("print", "sounding"), "id").alias("p"))
    classes = materialize(classes.select("key", "cid", "q", "p.*"), "media-classes")
    places = classes.select("cid", "q", F.posexplode(F.arrays_zip("print", "sounding")).alias("pos", "x")).filter("x.sounding").select("cid", "q", "pos", F.col("x.print").alias("value"))
    asked = places.filter("q").select("value", F.col("cid").alias("query"), F.col("pos").alias("at"))
    met = asked.join(places.select("value", "cid", "pos"), "value").filter("query != cid")
    voted = met.groupBy("query", "cid", (F.col("pos") - F.col("at")).alias("offset")).agg(F.count(F.lit(1)).alias("votes")).filter(F.col("votes") >= votes)
    own = classes.select("cid", "print")
    pair = voted.join(own, "cid").join(own.select(F.col("cid").alias("query"), F.col("print").alias("asked")), "query")
    first = F.greatest(F.lit(0), -F.col("offset"))
    overlap = F.least(F.size("asked") - first, F.size("print") - first - F.col("offset"))
    pair = pair.withColumn("overlap", overlap).filter(F.col("overlap") >= LEAST_OVERLAP)
    wrong = F.zip_with(F.slice("asked", first + 1, F.col("overlap")), F.slice("print", first + F.col("offset") + 1, F.col("overlap")), lambda a, b: F.bit_count(a.bitwiseXOR(b)))
    pair = pair.withColumn("bit_error", F.aggregate(wrong, F.lit(0), lambda s, x: s + x) / (32.0 * F.col("overlap"))).filter(F.col("bit_error") <= most_error)
    best = pair.groupBy("query", "cid").agg(F.min(F.struct("bit_error", (-F.col("overlap")).alias("less"), "offset")).alias("b"))
    matches = best.select(F.col("query").alias("query_class"), F.col("cid").alias("class_id"), F.col("b.offset").alias("offset"), (-F.col("b.less")).cast("int").alias("overlap"), F.col("b.bit_error").alias("bit_error"))
    members = prints.select("id", "key").join(classes.select("key", F.col("cid").alias("class_id")), "key", "left").select("id", "class_id")
    return members, matches


# --- recordings from vectors: the tables hold no media, so a vector is played as a tune


def tune(vector: list[float | None] | None) -> bytes | None:
    """WAV of a vector: one note of two partials a component, its pitch by the component's value."""
    if vector is None:
        return None
    x = np.array([0.0 if v is None or not np.isfinite(v) else v for v in vector])
    pitch = np.clip(np.floor((x + 1) * 24), 0, 47).astype(int)
    with io.BytesIO() as f:
        with wave.open(f, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(RATE)
            w.writeframes(_NOTES[pitch].tobytes())
        return f.getvalue()


_t = np.arange(HOP) / RATE
_f = 110.0 * 2 ** (np.arange(48)[:, None] / 12)
_NOTES = np.rint(12000 * np.sin(2 * np.pi * _f * _t) + 5000 * np.sin(4 * np.pi * np.minimum(_f, RATE / 5) * _t)).astype("<i2")


def play(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, media) of every vector, a WAV each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([tune(v) for v in part.column(1).to_pylist()], pa.binary())], names=["id", "media"])

    return vectors.select(F.col(id_col).cast("long").alias("id"), vector_col).mapInArrow(run, "id long, media binary")
