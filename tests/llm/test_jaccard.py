import random
import re

import pytest

from vellumist.llm import jaccard
from vellumist.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=5):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, percent=75):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x, (i, a) in enumerate(sets):
        for y, (j, b) in enumerate(sets[:x]):
            if i is not None and j is not None and a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[root(x)] = min(i, least.get(root(x), i))
    return sorted(((i, len(s), None if i is None else least[root(x)]) for x, (i, s) in enumerate(sets)), key=str)


def fixture(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)] + ["É", "ß日"]
    passage = rng.choices(vocab, k=60)
    rows = []
    for i in range(120):
        w = rng.choices(vocab, k=rng.choice([1, 3, 4, 5, 6, 20, 60, 150]))
        if i % 3 == 0:
            w += passage
        rows.append(w)
    for base in (7, 30, 33, 60):
        for _ in range(40):  # copies at all distances, around the threshold
            w = list(rows[base])
            for _ in range(rng.randint(0, 6)):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rows.append(w)
    rows += [rows[3]] * 20
    out = [(i * 3 + 1, rng.choice([" ", "\t", "\n", "  "]).join(w).upper() if i % 5 == 0 else " ".join(w)) for i, w in enumerate(rows)]
    out += [(2, None), (5, ""), (8, " \t\n"), (None, out[9][1]), (out[9][0], out[9][1]), (11, "one\x0btwo\x1cthree"), (14, "x " * 40_000)]
    rng.shuffle(out)
    return out


def run(spark, rows, n=7, **options):
    df = spark.createDataFrame([(i, t, "s", 1) for i, t in rows], "doc_id long, text string, id string, n int").repartition(n)
    return sorted(((r.id, r.n_shingles, r.component_id) for r in jaccard.join(df, **options).collect()), key=str)


@pytest.mark.parametrize("percent", [75, 60])
def test_against_brute_force(spark, percent):
    rows = fixture()
    assert run(spark, rows, percent=percent) == brute(rows, percent)


def test_hot_shingles_small_blocks_and_leaders(spark, monkeypatch):
    rows = fixture(2)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    monkeypatch.setattr(jaccard, "BLOCK_BYTES", 3000)
    assert run(spark, rows, 3) == brute(rows)


def test_empty_and_unlinked(spark):
    assert run(spark, [], 1) == []
    assert run(spark, [(1, "a b c d e f"), (2, None)], 1) == [(1, 2, 1), (2, 0, 2)]


def test_components_of_a_long_path(spark):
    edges = spark.range(60).selectExpr("id * 7 % 61 as a", "(id * 7 + 7) % 61 as b")
    assert {r.comp for r in components(edges).collect()} == {0}


def thue_morse(length, letters):
    bits = [bin(i).count("1") % 2 for i in range(length)]
    return "".join(letters[b] for b in bits)


def test_words_that_polynomial_hashes_confuse(spark):
    """Thue-Morse words collide under every polynomial hash modulo a power of two."""
    words = [thue_morse(2048, x) for x in ("ab", "ba", "cd", "dc")]
    assert words[0] != words[1]
    rows = [(1, " ".join([words[0]] * 3 + ["x"] * 4)), (2, " ".join([words[1]] * 3 + ["x"] * 4)), (3, words[2]), (4, words[3]), (5, "a"), (6, "a\0")]
    assert run(spark, rows, 2) == brute(rows)


def test_one_large_group_around_the_threshold(spark, monkeypatch):
    """Copies of one text at all distances, with cells in many parts and blocks."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(900)}" for _ in range(120)]
    rows = []
    for i in range(260):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"v{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard, "PART_BYTES", 9000)
    monkeypatch.setattr(jaccard, "ROUNDS", 1)
    assert run(spark, rows) == brute(rows)
