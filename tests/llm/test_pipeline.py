import re

import pytest

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")
pipeline = pytest.importorskip("corpus_pipeline")

from vellumist.llm import bpe  # noqa: E402
from vellumist.runtime import materialize, read_table  # noqa: E402

SF = "/root/testdata/sf0.001"
TOKEN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})""", re.I | re.A)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_every_stage_against_brute_force(spark):
    docs = read_table(spark, SF, "documents")
    columns, kept = docs.columns, [docs]
    for name, stage in pipeline.STAGES:
        kept.append(materialize(stage(spark, kept[-1], SF), f"test-{name}"))
        assert name == pipeline.STAGES[-1][0] or kept[-1].columns == columns
    raw, good, one, clean, mixed, ids = (k.collect() for k in kept)

    labels = {r.doc_id: r.quality for r in read_table(spark, SF, "labels").collect()}
    passed = {r.doc_id for r in good}
    marked = [r.doc_id for r in raw if r.doc_id in labels]
    assert sum((d in passed) == bool(labels[d]) for d in marked) >= 0.95 * len(marked)
    assert all(d in passed for d in marked if labels[d])

    sets = {r.doc_id: shingles(r.text) for r in good}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    assert {r.doc_id for r in one} == {d for d in sets if root(d) == d}

    assert {r.doc_id for r in clean} == {r.doc_id for r in one}
    before = {r.doc_id: r.text for r in one}
    for r in clean:
        assert not TOKEN.search(r.text) and r.n_chars == len(r.text)
        assert "[REDACTED]" in r.text or r.text == before[r.doc_id]

    counts = {}
    for r in mixed:
        counts[r.doc_id] = counts.get(r.doc_id, 0) + 1
    assert set(counts) <= set(before) and max(counts.values()) <= 3 and len(mixed) == len(ids)
    text = {r.doc_id: r.text for r in mixed}
    real = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert all(r.ids == real.encode_ordinary(text[r.doc_id]) for r in ids)


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    from pyspark.sql import functions as F

    docs = read_table(spark, SF, "documents").limit(30)
    extra = {c: F.lit("own") for c in ("score", "predicted", "copy", "size", "key", "__score", "id")}
    odd = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.lit(None).cast("string")).otherwise(""))
    docs = docs.unionByName(docs).unionByName(odd.withColumn("doc_id", F.lit(None).cast("long"))).withColumns(extra)
    for name, stage in pipeline.STAGES[:-1]:
        out = materialize(stage(spark, docs, SF), f"test-odd-{name}")
        assert out.columns == docs.columns and {r[c] for r in out.collect() for c in extra} <= {"own"}, name
        assert stage(spark, docs.limit(0), SF).count() == 0
        docs = out
    assert pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count() > 0


def test_redaction_follows_the_links_of_parts(spark):
    texts = {1: "user: alice, password: abc12", 2: "login=Xy9zXy9zXy9zXy9zXy9z", 3: "login=bob " + "z" * 250 + " password: abc", 4: "url=http://db.example.com user: alice, password: abc"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r.doc_id: r.text for r in pipeline.secret_redaction(spark, docs, SF).collect()}
    # A token is not its own complement, too far parts are not linked, endpoints stay.
    assert out == {1: "[REDACTED], [REDACTED]", 2: texts[2], 3: texts[3], 4: "url=http://db.example.com [REDACTED], [REDACTED]"}
