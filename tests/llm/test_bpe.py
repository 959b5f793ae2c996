import hashlib
import random

import pytest

tiktoken = pytest.importorskip("tiktoken")
P = pytest.importorskip("public_tokenizers")

from vellumist.llm import bpe  # noqa: E402

PATH = P.path("byte_bpe_50k.tiktoken")
rng = random.Random(3)
SIGNS = "abcdeEéßñ日😀 '\t\n\r\x1c\x85\xa0 　.,!?019²Ⅳ-_s"
TEXTS = [None, "", " ", "a  b", "it's we'll I'D x'm", "<|endoftext|> x", "tail   \n", "=" * 5000, "ab" * 3000, "zqxj" * 100 + " " + "é" * 400, "The the THE  the\n\nthe"]
TEXTS += ["".join(rng.choices(SIGNS, k=rng.randint(1, 300))) for _ in range(150)]
TEXTS += ["".join(rng.choices("etaoin srhldcum", k=rng.randint(1, 3000))) for _ in range(40)]


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(PATH), special_tokens={})


def test_ids_and_round_trip(spark, reference):
    docs = spark.createDataFrame([(i, "x", t) for i, t in enumerate(TEXTS)] + [(3, "y", TEXTS[3])], "doc_id long, ids string, text string")
    rows = bpe.encode(docs, PATH, P.PATTERN, with_ids=True).collect()
    assert len(rows) == len(TEXTS) + 1
    for r in rows:
        text = TEXTS[r.doc_id] or ""
        want = reference.encode_ordinary(text)
        assert r.ids == want and r.n_tokens == len(want)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_heap_equals_recursion_and_state_is_bounded(reference, monkeypatch):
    own = bpe.Codec(bpe.read_ranks(PATH), P.PATTERN)
    pieces = ["".join(rng.choices("etaoinshr", k=rng.randint(2, 60))).encode() for _ in range(300)]
    ids, counts = own.recursive(pieces)
    assert (ids.tolist(), counts.tolist()) == (sum(map(own.heap, pieces), []), [len(own.heap(p)) for p in pieces])
    monkeypatch.setattr(bpe, "MOST_UNITS", 5)
    monkeypatch.setattr(bpe, "DECODE_ROWS", 7)
    for text in TEXTS[4:20]:
        flat, counts, _ = own.encode([text, text])
        assert flat.tolist() == reference.encode_ordinary(text) * 2
        assert own.decode(flat, counts) == [text.encode()] * 2


def test_empty_table(spark):
    assert bpe.encode(spark.createDataFrame([], "doc_id long, text string"), PATH, P.PATTERN).count() == 0


def test_forgetting_keeps_short_units_used_often(reference, monkeypatch):
    own = bpe.Codec(bpe.read_ranks(PATH), P.PATTERN)
    monkeypatch.setattr(bpe, "MOST_UNITS", 4)
    long = "qzx" * 400
    own.encode(["common " * 9 + "usual " * 5 + "rare once", long, long, long])
    own.forget()
    assert list(own.units) == [" common", " usual"]
    text = " usual rare common " + long
    flat, _, said = own.encode([text])
    assert flat.tolist() == reference.encode_ordinary(text)
    assert said.to_pylist() == [" ".join(map(str, flat.tolist()))]


def test_a_share_bounds_the_state_and_keeps_the_ids(reference):
    whole, part = (bpe.Codec(bpe.read_ranks(PATH), P.PATTERN, share) for share in (1, bpe.MOST_UNITS // 50))
    texts = [" ".join(f"w{i * k}x" for i in range(60)) for k in range(1, 9)] + [""]
    most = []
    for t in texts:
        (a, n, x), (b, m, y) = whole.encode([t]), part.encode([t])
        assert a.tolist() == b.tolist() == reference.encode_ordinary(t) and n.tolist() == m.tolist() and x.equals(y)
        assert part.decode(b, m) == [t.encode()]
        most.append(len(part.units))
    assert max(most) <= 50 + 60 < len(whole.units)


def test_long_pieces_go_through_the_recursion(reference, monkeypatch):
    monkeypatch.setattr(bpe.Codec, "heap", None)
    monkeypatch.setattr(bpe, "LONG_BYTES", 5000)
    own = bpe.Codec(bpe.read_ranks(PATH), P.PATTERN)
    signs = ["etaoinshr", "=-*_", "aab", "qz", "éß日本", "0129", ["=", "==", "-" * 5, "_="], ["ab", "c", "ing", "er"]]
    pieces = ["".join(rng.choices(s, k=rng.randint(200, 900))) for s in signs for _ in range(6)] + ["=" * 9000, "ab" * 4000, "日本" * 300]
    flat, counts, _ = own.encode(pieces)
    ends = counts.cumsum()
    assert own.regular and [flat[e - n : e].tolist() for e, n in zip(ends, counts)] == [reference.encode_ordinary(p) for p in pieces]


def test_long_pieces_by_ranks_that_fall():
    tokens = [bytes([i]) for i in range(256)] + [b"abc", b"cab", b"ab", b"bc", b"aa", b"ca", b"aab", b"abab"]
    own = bpe.Codec({t: i for i, t in enumerate(tokens)}, P.PATTERN)
    pieces = ["".join(rng.choices("abc", k=rng.randint(193, 300))).encode() for _ in range(20)]
    ids, counts = own.recursive_long(pieces)
    assert not own.regular
    assert (ids.tolist(), counts.tolist()) == (sum(map(own.heap, pieces), []), [len(own.heap(p)) for p in pieces])


def test_a_very_long_piece_has_memory_enough():
    own = bpe.Codec(bpe.read_ranks(PATH), P.PATTERN)
    piece = b"ab" * 500_000
    ids, counts = own.recursive_long([piece])
    assert ids.tolist() == own.heap(piece) and counts.tolist() == [len(ids)]
