"""Language identification by string kernels.

Two texts are as alike as the n-grams they share: the blended-spectrum presence kernel counts the byte n-grams (n = 2, 3, 4, hashed to
``WIDTH`` columns, capitals folded, signs and digits as one) present in both, divided by the geometric mean of their own counts. Nyström landmarks, texts of every
language, turn the kernel into features K(x, L) K(L, L)^(-1/2); one-versus-rest ridge regression on those features gives
a value for each language. As the kernel is linear in the presence rows, the landmarks, the root and the weights fold into one
matrix, and a batch of whole texts is scored by one product of its presence rows with it.

The model is fitted on about ``PER_LANGUAGE`` texts of each language, about ``MOST_ROWS`` in all or two a language, chosen by a hash of the
id; they come to the driver as presence bits of ``WIDTH`` / 8 bytes each. No language is left out: more languages have fewer texts and landmarks
each, and the folded matrix takes ``WIDTH`` * 4 bytes a language.

Defined cases: ``und`` with score 0 for a null text or one without a letter, and for every text if nothing was learned; rows without an id may be scored, never
learned from; repeated rows are scored each; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 1 << 15
ORDERS = (2, 3, 4)
PER_LANGUAGE, LANDMARKS = 500, 48
#: Bounds over all languages together.
MOST_ROWS, MOST_LANDMARKS = 10_000, 960
RIDGE, SHARPNESS = 1e-3, 5.0
UNKNOWN = "und"
ROWS, SLICE_BYTES = 256, 2_000_000

LETTER = re.compile(r"[^\W\d_]")

_FOLD = np.full(256, 32, dtype=np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
_FOLD[0] = 0


def presence(texts: list[bytes]) -> np.ndarray:
    """A 0/1 row for each text: which hashed n-grams it has."""
    out = np.zeros((len(texts), WIDTH), dtype=np.float32)
    if not texts:
        return out
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    code = _FOLD[raw]
    latin = np.flatnonzero(raw[:-1] == 0xC3) + 1  # capitals with accents, two bytes each
    latin = latin[(raw[latin] >= 0x80) & (raw[latin] <= 0x9E) & (raw[latin] != 0x97)]
    code[latin] += 32
    spaced = (code[1:] == 32) & (code[:-1] == 32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int64) * WIDTH, lengths)
    keep = np.append(True, ~spaced)  # a run of signs and spaces is one
    code, owner = code[keep], owner[keep]
    flat = out.reshape(-1)
    gram = code.copy()
    for n in range(2, max(ORDERS) + 1):
        gram = gram[:-1] * np.uint32(0x01000193) + code[n - 1 :] + np.uint32(n)
        if n in ORDERS:
            at = ((gram * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)
            whole = owner[: len(gram)] == owner[n - 1 :]
            flat[(at + owner[: len(gram)])[whole]] = 1
    return out


def normed(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt(np.maximum(1.0, rows.sum(axis=1, keepdims=True)))


def unpacked(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits, axis=1).astype(np.float32)


def fit(bits: np.ndarray, langs: list[str]) -> dict | None:
    """Folded weights (WIDTH x languages) and offsets from packed presence bits and their languages.

    Rows are unpacked ROWS at a time, so the driver holds the landmarks and the kernel columns besides the bits.
    """
    names = sorted(set(langs))
    if not names:
        return None
    y = np.array([names.index(x) for x in langs])
    each = max(1, min(LANDMARKS, MOST_LANDMARKS // len(names)))
    chosen = np.concatenate([np.flatnonzero(y == i)[:each] for i in range(len(names))])
    marks = normed(unpacked(bits[chosen]))
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good]) @ vectors[:, good].T
    kernel = np.concatenate([normed(unpacked(bits[i : i + ROWS])) @ marks.T for i in range(0, len(bits), ROWS)])
    z = kernel.astype(np.float64) @ root
    mean = z.mean(axis=0)
    z = z - mean
    goal = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    share = np.bincount(y, minlength=len(names)) / len(y)
    weight = (1 / (share[y] * len(names)))[:, None]  # every language counts alike
    base = (goal * weight).sum(axis=0) / weight.sum()
    beta = np.linalg.solve(z.T @ (z * weight) + RIDGE * len(y) * np.eye(z.shape[1]), z.T @ ((goal - base) * weight))
    return {"names": names, "v": marks.T @ (root @ beta).astype(np.float32), "b": base - mean @ beta}


def predict(model: dict | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    found = [UNKNOWN] * len(texts)
    scores = np.zeros(len(texts))
    real = [i for i, t in enumerate(texts) if t and LETTER.search(t)]
    if model is None or not real:
        return found, scores
    value = normed(presence([texts[i].encode() for i in real])) @ model["v"] + model["b"]
    e = np.exp(SHARPNESS * (value - value.max(axis=1, keepdims=True)))
    best = value.argmax(axis=1)
    for i, k in zip(real, best):
        found[i] = model["names"][k]
    scores[real] = (e / e.sum(axis=1, keepdims=True))[np.arange(len(real)), best]
    return found, scores


def train(docs: DataFrame, trainable: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict | None:
    rows = docs.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & F.col(id_col).isNotNull() & trainable)
    counts = rows.groupBy(F.col(lang_col).cast("string").alias("lang")).count().orderBy("lang").collect()
    if not counts:
        return None
    each = max(2, min(PER_LANGUAGE, MOST_ROWS // len(counts)))
    # Of each language about so many rows: those whose hash is below its own bound.
    bound = rows.sparkSession.createDataFrame([(r["lang"], int(min(1.0, each / r["count"]) * (1 << 30))) for r in counts], "__lang string, __bound long")
    few = rows.join(F.broadcast(bound), F.col(lang_col).cast("string") == F.col("__lang")).filter(F.pmod(F.xxhash64(F.lit(3), F.col(id_col)), F.lit(1 << 30)) < F.col("__bound"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                packed = np.packbits(presence([t.encode() for t in part.column(0).to_pylist()]).astype(bool), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array([p.tobytes() for p in packed], pa.binary()), part.column(1)], names=["bits", "lang"])

    got = few.select(F.col(text_col).cast("string"), F.col(lang_col).cast("string")).mapInArrow(bits, "bits binary, lang string").orderBy(F.xxhash64("bits"), "lang").collect()
    return fit(np.frombuffer(b"".join(bytes(r.bits) for r in got), np.uint8).reshape(len(got), WIDTH // 8), [r.lang for r in got])


def identify(docs: DataFrame, model: dict | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, lang_pred, score."""
    fields = [docs.schema[id_col], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            langs: list[str] = []
            scores: list[np.ndarray] = []
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and upto - at < ROWS and (upto == at or size + len(texts[upto] or "") <= SLICE_BYTES):
                    size += len(texts[upto] or "")
                    upto += 1
                names, values = predict(sent.value, texts[at:upto])
                langs += names
                scores.append(values)
                at = upto
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else np.empty(0), pa.float64())], names=[f.name for f in fields])

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))
