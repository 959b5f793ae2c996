import io
import random
import wave

import numpy as np
from pyspark.sql import functions as F

from vellumist.llm import media


def wav(samples, rate=media.RATE):
    with io.BytesIO() as f:
        with wave.open(f, "wb") as w:
            w.setnchannels(1)
            w.setsampwidth(2)
            w.setframerate(rate)
            w.writeframes(np.clip(samples, -32768, 32767).astype("<i2").tobytes())
        return f.getvalue()


def fixture():
    rng, noise = random.Random(2), np.random.default_rng(2)
    rows = []
    for i in range(30):
        tune = np.frombuffer(media.tune([rng.uniform(-1, 1) for _ in range(64)])[44:], "<i2").astype(float)
        rows.append((i * 10, wav(tune)))
        if i % 2 == 0:  # cut at a frame boundary, quieter, noisy, with another ending
            cut = tune[media.HOP * rng.randint(0, 12) :] * 0.6 + noise.normal(0, 150, 1)[0]
            cut[-media.HOP * 3 :] = 0
            rows.append((i * 10 + 1, wav(cut + noise.normal(0, 100, len(cut)))))
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (2, None), (3, b"junk"), (4, wav(np.zeros(100))), (5, wav(np.zeros(30_000))), (6, wav(np.zeros(30_000))), (None, rows[0][1])]
    return rows


def brute(prints):
    out = {}
    for q, (a, own) in prints.items():
        for c, (b, _) in prints.items():
            best = None
            for offset in range(-len(a) + media.LEAST_OVERLAP, len(b) - media.LEAST_OVERLAP + 1):
                first = max(0, -offset)
                n = min(len(a) - first, len(b) - first - offset)
                wrong = sum((x ^ y).bit_count() for x, y in zip(a[first : first + n], b[first + offset : first + offset + n]))
                if n >= media.LEAST_OVERLAP and wrong <= media.MOST_ERROR * 32 * n:
                    best = min(best or (9, 0, 0), (wrong / (32 * n), -n, offset))
            if best and a != b and any(own):
                out[q, c] = best
    return out


def test_recall_against_brute_force(spark):
    rows = fixture()
    prints = media.fingerprints(spark.createDataFrame([(i, m, "x") for i, m in rows], "id long, media binary, print string"))
    members, matches = media.align(prints, F.lit(True))
    got = {(r.query_class, r.class_id): (r.bit_error, -r.overlap, r.offset) for r in matches.collect()}
    local = {r.id: (r.print, r.sounding) for r in prints.collect() if r.print and r.id < 1000}
    want = brute(local)
    assert len(want) >= 20
    assert len(set(got) & set(want)) >= 0.9 * len(want)
    assert all(got[k] == want[k] for k in got)
    classes = {r.id: r.class_id for r in members.collect()}
    assert classes[1000] == classes[1001] == classes[0] == 0 and classes[6] == classes[5]
    assert classes[2] is classes[3] is classes[4] is None and None not in classes


def test_queries_and_empty(spark):
    rows = fixture()
    prints = media.fingerprints(spark.createDataFrame(rows, "id long, media binary"))
    _, matches = media.align(prints, F.col("id") == 1000)  # a copy of 0 asks for its class
    assert {r.query_class for r in matches.collect()} == {0}
    members, matches = media.align(prints.limit(0), F.lit(True))
    assert members.count() == matches.count() == 0
