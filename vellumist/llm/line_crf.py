"""Document quality from a linear-chain conditional random field over lines.

Each line is good or bad. Its features describe its characters and words (share of letters, capitals, digits, signs, doubled signs, bars,
repeated words, function words, length, ending) and those of the neighbouring lines; a transition matrix ties the labels of
neighbours. Training lines take the label of their document. Forward-backward marginals, weighted by the lines' lengths, give the expected
good share of a document; a logistic curve over that share and the worst line's marginal, fitted on the same sample, gives the score.

The classifier is fitted on at most about ``SAMPLE`` labelled documents, chosen by a hash of their id, in the hash's order as long as they have no more
than ``SAMPLE_LINES`` lines together; an id that several rows have counts once, with its least text. Features of the sample are computed where the
texts are, and only they come to the driver, at most 250 bytes a line. Scoring covers every whole text, one pass, no shuffle, in slices of bounded bytes.

Defined cases: a null text, an empty one and one without any word score as the mean of an empty line does; lines without words are left out of a text that has others; rows that
repeat are scored each; other columns are ignored; an empty table gives an empty result; without training rows of both labels every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumist.llm.batches import bound_batches, hand_back, keep, slices
from vellumist.runtime import materialize

SAMPLE = 6000
SAMPLE_LINES = 200_000
SLICE, SLICE_BYTES = 400, 1_000_000
THRESHOLD = 0.3

#: Function words: the commonest of four languages, enough to tell running text from lists of words.
FUNCTION_WORDS = frozenset(
    "the of and to in is it that for was on are as with be by at from this have or not he she they you we but an a "
    "der die das und in zu den von mit sich des auf für ist im dem nicht ein eine als auch es an "
    "le la les de des et en un une du que est pour qui dans pas sur au par il elle ne se "
    "el los las y que en por con no para es su al lo como más una del se".split()
)

_CLASS = np.zeros((256, 6), dtype=np.int32)  # letter, capital, digit, sign, bar, sentence mark
_CLASS[[*range(65, 91), *range(97, 123), *range(0xC2, 0xF5)], 0] = 1
_CLASS[65:91, 1] = 1
_CLASS[48:58, 2] = 1
_CLASS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)], 3] = 1
_CLASS[ord("|"), 4] = 1
_CLASS[[ord(c) for c in ".,;:'"], 5] = 1
BASE = 16
FEATURES = BASE * 3 + 12 + 1


def line_features(line: str) -> list[float]:
    raw = np.frombuffer(line.encode(), np.uint8)
    words = line.split()
    count = max(1, len(words))
    letters, capitals, digits, signs, bars, marks = _CLASS[raw].sum(axis=0).tolist() if len(raw) < 400 else [int(np.bincount(raw, minlength=256) @ _CLASS[:, k]) for k in range(6)]
    capitals += line.count("É") + line.count("È") + line.count("Ä") + line.count("Ö") + line.count("Ü") + line.count("Ñ") + line.count("Ç")
    solid = max(1, letters + digits + signs)
    doubled = int(((raw[1:] == raw[:-1]) & (_CLASS[raw[1:], 3] > 0)).sum())
    again = sum(map(str.__eq__, words, words[1:]))
    function = sum(w in FUNCTION_WORDS for w in line.lower().split())
    return [
        min(1.0, np.log1p(len(words)) / 6),
        letters / solid,
        capitals / max(1, letters),
        digits / solid,
        (signs - marks - bars) / solid,
        doubled / solid,
        bars / count,
        line.count("!") / count,
        again / count,
        1 - len(set(words)) / count,
        function / count,
        min(2.0, letters / count / 10),
        float(line.rstrip()[-1:] in (".", "!", "?", '"', ":")),
        float(len(words) < 3),
        sum(w[:1].isupper() for w in words) / count,
        line.count(".") / count,
    ]


def text_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(lines x FEATURES, weights) of a text: own, neighbours' and the whole text's features."""
    lines = [x for x in (text or "").split("\n") if x.strip()] or [""]
    base = np.array([line_features(x) for x in lines], dtype=np.float64)
    weights = np.array([max(1, len(x)) for x in lines], dtype=np.float64)
    before, after = np.vstack([base[:1], base[:-1]]), np.vstack([base[1:], base[-1:]])
    seen: dict[str, int] = {}
    for x in lines:
        seen[x] = seen.get(x, 0) + 1
    own = np.array([float(seen[x] > 1) for x in lines])
    sharp = np.minimum(1.0, base[:, [2, 4, 5, 6, 7, 8, 9, 10, 3]] / np.array([0.5, 0.05, 0.03, 0.2, 0.2, 0.1, 0.5, 0.25, 0.2]))
    whole = np.average(base, axis=0, weights=weights)
    extra = np.column_stack([own, sharp, np.full(len(lines), whole[9]), np.full(len(lines), min(1.0, np.log1p(len(lines)) / 5))])
    return np.hstack([base, (before + after) / 2, np.abs(base - (before + after) / 2), extra, np.ones((len(lines), 1))]).astype(np.float32), weights


def marginals(unary: np.ndarray, lengths: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward over chains laid end to end: log Z of each, P(label) of each line, expected transitions.

    unary: (lines, 2) potentials; transition: (2, 2). Steps run over positions, for all chains at once.
    """
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    alive = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left") if len(sizes) else np.empty(0, int)
    forward, backward = np.empty_like(unary), np.zeros_like(unary)

    def lse(x: np.ndarray) -> np.ndarray:
        m = x.max(axis=1, keepdims=True)
        return (m + np.log(np.exp(x - m).sum(axis=1, keepdims=True)))[:, 0]

    for t, n in enumerate(alive):
        at = starts[:n] + t
        if t == 0:
            forward[at] = unary[at]
        else:
            back = forward[at - 1]
            forward[at] = unary[at] + np.column_stack([lse(back + transition[:, y]) for y in (0, 1)])
    for t in range(len(alive) - 2, -1, -1):
        at = starts[: alive[t + 1]] + t
        ahead = unary[at + 1] + backward[at + 1]
        backward[at] = np.column_stack([lse(ahead + transition[y]) for y in (0, 1)])
    z = np.empty(len(lengths))
    z[order] = lse(forward[starts + sizes - 1])
    every = np.repeat(z, lengths)
    prob = np.exp(forward + backward - every[:, None])
    inner = np.ones(len(unary), bool)
    inner[np.cumsum(lengths) - lengths] = False
    j = np.flatnonzero(inner)
    pairs = np.zeros((2, 2))
    for a in (0, 1):
        for b in (0, 1):
            pairs[a, b] = np.exp(forward[j - 1, a] + transition[a, b] + unary[j, b] + backward[j, b] - every[j]).sum()
    return z, prob, pairs


def document_view(prob: np.ndarray, weights: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Of each document: length-weighted share of good, and its worst line's marginal weighted by that line's share."""
    starts = np.cumsum(lengths) - lengths
    total = np.add.reduceat(weights, starts)
    share = np.add.reduceat(prob[:, 1] * weights, starts) / total
    worst = np.maximum.reduceat(prob[:, 0] * np.minimum(1.0, weights / np.repeat(total, lengths) * 4), starts)
    return np.column_stack([share, worst, np.ones(len(lengths))])


def _ascend(gradient, start: np.ndarray, steps: int, rate: float) -> np.ndarray:
    """Adam, for a concave objective."""
    x, m, v = start.copy(), np.zeros_like(start), np.zeros_like(start)
    for i in range(1, steps + 1):
        g = gradient(x)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        x += rate * (1 - i / (steps + 1)) * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.99**i)) + 1e-9)
    return x


def fit(texts: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, steps: int = 300) -> dict:
    """CRF weights and the logistic curve from features and labels of a sample."""
    if not len(labels) or labels.min() == labels.max():
        return {"flat": float(labels.mean()) if len(labels) else 0.5}
    lengths = np.array([len(w) for _, w in texts])
    # The matrix of all lines is made once and changed where it stands, as it is the driver that holds it.
    x, weights = np.empty((int(lengths.sum()), texts[0][0].shape[1])), np.concatenate([w for _, w in texts])
    np.concatenate([f for f, _ in texts], out=x)
    mean = x.mean(axis=0)
    scale = np.sqrt([np.square(x[:, k] - mean[k]).mean() for k in range(x.shape[1])]) + 1e-6
    mean[-1], scale[-1] = 0, 1
    x -= mean
    x /= scale
    y = np.repeat(labels, lengths)
    one, d = np.eye(2)[y], x.shape[1]
    seen = np.zeros((2, 2))
    inner = np.ones(len(y), bool)
    inner[np.cumsum(lengths) - lengths] = False
    np.add.at(seen, (y[np.flatnonzero(inner) - 1], y[inner]), 1)

    def gradient(theta: np.ndarray) -> np.ndarray:
        unary = np.column_stack([np.zeros(len(x)), x @ theta[:d]])
        _, prob, pairs = marginals(unary, lengths, theta[d:].reshape(2, 2))
        return np.concatenate([x.T @ (one - prob)[:, 1] / len(x), ((seen - pairs) / len(x)).ravel()]) - 1e-4 * theta

    theta = _ascend(gradient, np.zeros(d + 4), steps, 0.15)
    crf = {"w": theta[:d], "t": theta[d:].reshape(2, 2), "mean": mean, "scale": scale}
    view = document_view(_prob(crf, x, lengths), weights, lengths)
    curve = _ascend(lambda c: view.T @ (labels - 1 / (1 + np.exp(-view @ c))) / len(labels) - 1e-4 * c, np.zeros(3), 1500, 0.1)
    return crf | {"curve": curve}


def _prob(crf: dict, x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    return marginals(np.column_stack([np.zeros(len(x)), x @ crf["w"]]), lengths, crf["t"])[1]


def score(crf: dict, texts: list[str | None]) -> np.ndarray:
    if "flat" in crf or not texts:
        return np.full(len(texts), crf.get("flat", 0.5))
    found = [text_features(t) for t in texts]
    lengths = np.array([len(w) for _, w in found])
    x = (np.concatenate([f for f, _ in found]) - crf["mean"]) / crf["scale"]
    view = document_view(_prob(crf, x, lengths), np.concatenate([w for _, w in found]), lengths)
    return 1 / (1 + np.exp(-view @ crf["curve"]))


def train(docs: DataFrame, labels: DataFrame, trainable: Column, label_col: str = "quality", id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> dict:
    """Fit on about ``sample`` labelled rows for which ``trainable`` holds, chosen by a hash of the id."""
    usable = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & trainable).groupBy(id_col).agg(F.min(label_col).alias("label"))
    n = usable.count()
    part = min(1.0, sample / max(1, n))
    # About 4 standard deviations above the sample size is the bound of what is broadcast.
    chosen = usable.filter(F.pmod(F.xxhash64(F.lit(5), F.col(id_col)), F.lit(1 << 30)) < int(part * (1 << 30))).limit(sample + 4 * int(sample**0.5))
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(id_col, text.alias("text")).join(F.broadcast(chosen), id_col).groupBy(id_col, "label").agg(F.min("text").alias("text"))
    rows = materialize(rows.withColumn("h", F.xxhash64(F.lit(6), id_col)).withColumn("lines", F.size(F.split("text", "\n"))), "crf-sample")
    # The window is over at most the sample's rows, without their texts.
    before = F.sum("lines").over(Window.orderBy("h", id_col))
    within = rows.select(id_col, "h", "lines").withColumn("upto", before).filter(F.col("upto") <= SAMPLE_LINES).select(id_col)
    rows = rows.join(F.broadcast(within), id_col, "left_semi").select("text", "label")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep()
        for batch in batches:
            for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                x, w = text_features(text)
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()]), pa.array([w.tobytes()]), pa.array([label], pa.int32())], names=["x", "w", "label"])

    got = rows.withColumn("label", F.col("label").cast("int")).mapInArrow(features, "x binary, w binary, label int").collect()
    got.sort(key=lambda r: (r.label, bytes(r.x), bytes(r.w)))
    texts = [(np.frombuffer(r.x, np.float32).reshape(-1, FEATURES), np.frombuffer(r.w, np.float64)) for r in got]
    crf = fit(texts, np.array([r.label for r in got], dtype=np.int64))
    del got, texts
    hand_back()
    return crf


def classify(docs: DataFrame, crf: dict, text_col: str = "text", threshold: float = THRESHOLD, score_col: str = "score", predicted_col: str = "predicted") -> DataFrame:
    """docs with a score and a prediction. Columns of their two names are replaced."""
    bound_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c not in (score_col, predicted_col)]
    place = kept.index(text_col)
    fields = [docs.schema[c] for c in kept] + [T.StructField(score_col, T.DoubleType()), T.StructField(predicted_col, T.IntegerType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep()
        for batch in batches:
            scores = np.concatenate([np.empty(0), *(score(crf, part.column(place).to_pylist()) for part in slices(batch, place, SLICE_BYTES, SLICE))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64()), pa.array((scores >= threshold).astype(np.int32))], names=[f.name for f in fields])
        hand_back()

    return docs.select(*kept).mapInArrow(run, T.StructType(fields))
