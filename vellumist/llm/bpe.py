"""Byte-level BPE encoding and decoding, as recursive DuckDB queries in each partition.

A text is cut into pieces by the tokenizer's pattern. The distinct pieces of a slice of a partition that are not yet
known go to DuckDB as token-position rows, one a byte. The query joins neighbouring tokens with the merge table (left
id, right id, rank of their concatenation) and lists each piece's tokens and pair ranks in order; its recursion contracts the leftmost
pair of minimum rank of each piece, joins the new token with its two neighbours to the merge table, and goes on until no piece has a pair left. Whole pieces that are a token themselves are that token, as in the
reference encoding. Decoding joins the ids of whole texts with the vocabulary and concatenates the bytes by an ordered aggregation.

A round of that recursion contracts one pair, which is quadratic in a piece's length. Pieces over ``LONG_PIECE`` bytes (unbroken runs of thousands of
letters or signs) go through a recursion over a row a token, whose rounds contract all pairs that are of least rank for ``MARGIN`` times the length of
the longest token that the piece holds, before and after. No token grows over such a distance, so what is contracted elsewhere meanwhile does not reach
them; of a chain of overlapping pairs of one rank, every other one is contracted, from the left, once the whole chain is of least rank. That gives the same ids where no
contraction makes a pair of lower rank than its own, which is looked at for the vocabulary (``regular``); else a round contracts the leftmost pair of least rank.
State is bounded: beyond ``MOST_UNITS`` known units or ``MOST_IDS`` of their ids, all are forgotten but the short ones used most, at most half; slices hold
``SLICE_CHARS`` of text, or one text. A ``share`` divides these bounds, where executors hold much else. What is known changes only the work, never an id.

Defined cases: a null or empty text has no tokens; repeated rows are encoded each; other columns are ignored; an empty table gives
an empty result. Special tokens are never recognised: their strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import cached_property
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vellumist.llm.batches import BATCH_BYTES, bound_batches, hand_back, keep, slices

LONG_PIECE = 192
MARGIN = 4
#: Bytes of long pieces of one recursion, or one piece.
LONG_BYTES = 200_000
SLICE_CHARS = 1_500_000
DECODE_ROWS = 300_000
#: Pieces of one recursion.
ENCODE_PIECES = 10_000
MOST_UNITS, MOST_IDS = 500_000, 4_000_000
#: Ids of a unit that is short.
SHORT_UNIT = 64
#: The vocabulary goes to every executor, so its file has a limit.
MOST_VOCAB_BYTES = 64 << 20

#: Unicode White_Space, which is what \s means to the pattern.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: No piece of the pattern spans these units, so equal units have equal pieces.
UNIT = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

NONE = 1 << 30
ENCODE = f"""
WITH RECURSIVE pairs AS (SELECT k, t, lead(t) OVER (PARTITION BY k // 256 ORDER BY k) AS nt FROM bytes_in),
ranked AS (
    SELECT k // 256 AS w, list(p.t ORDER BY k) AS t, list(coalesce(m.r, {NONE}) ORDER BY k) AS r
    FROM pairs p LEFT JOIN merges m ON m.a = p.t AND m.b = p.nt GROUP BY 1),
step(w, t, r, least) AS (
    SELECT w, t, r, list_min(r) FROM ranked
    UNION ALL
    (WITH leftmost AS (SELECT w, t, r, least, list_position(r, least) AS i FROM step WHERE least < {NONE}),
    sides AS (SELECT *, t[i - 1] AS before, t[i + 2] AS after FROM leftmost),
    contracted AS (
        SELECT w, t[: i - 1] || [least] || t[i + 2 :] AS t,
               CASE WHEN i > 1 THEN s.r[: i - 2] || [coalesce(x.r, {NONE})] ELSE [] :: INTEGER[] END
               || [coalesce(y.r, {NONE})] || s.r[i + 2 :] AS r
        FROM sides s LEFT JOIN merges x ON x.a = s.before AND x.b = s.least LEFT JOIN merges y ON y.a = s.least AND y.b = s.after)
    SELECT w, t, r, list_min(r) FROM contracted)
)
SELECT w, t AS ids FROM step WHERE least = {NONE} ORDER BY w
"""

#: Keyed by piece and first byte: a round lists the tokens that changed, and those that were contracted into the one before as -1.
ENCODE_LONG = f"""
WITH RECURSIVE tokens(w, k, t, r, reach) USING KEY (w, k) AS (
    SELECT p.w, p.k, p.t, coalesce(m.r, {NONE}), p.reach
    FROM (SELECT *, lead(t) OVER (PARTITION BY w ORDER BY k) AS nt FROM long_in) p LEFT JOIN merges m ON m.a = p.t AND m.b = p.nt
    UNION
    (WITH near AS (
        SELECT *, min(r) OVER (PARTITION BY w ORDER BY k RANGE BETWEEN reach PRECEDING AND reach FOLLOWING) AS least,
               coalesce(lag(r) OVER (PARTITION BY w ORDER BY k) <> r, true) AS fresh
        FROM recurring.tokens WHERE t >= 0),
    chained AS (SELECT *, sum(fresh :: INTEGER) OVER (PARTITION BY w ORDER BY k) AS c FROM near),
    chosen AS (SELECT *, r < {NONE} AND CHOICE AS here FROM chained),
    dealt AS (SELECT *, coalesce(lag(here) OVER (PARTITION BY w ORDER BY k), false) AS gone, lead(t) OVER (PARTITION BY w ORDER BY k) AS old FROM chosen),
    kept AS (SELECT w, k, reach, here, old, CASE WHEN here THEN r ELSE t END AS t FROM dealt WHERE NOT gone),
    pairs AS (SELECT *, lead(t) OVER (PARTITION BY w ORDER BY k) AS nt FROM kept)
    SELECT p.w, p.k, p.t, coalesce(m.r, {NONE}), p.reach
    FROM pairs p LEFT JOIN merges m ON m.a = p.t AND m.b = p.nt WHERE p.here OR p.nt IS DISTINCT FROM p.old
    UNION ALL SELECT w, k, -1, {NONE}, reach FROM dealt WHERE gone)
)
SELECT w, list(t ORDER BY k) AS ids FROM tokens WHERE t >= 0 GROUP BY w ORDER BY w
"""
#: Which pairs a round contracts, by regular.
CHOICE = {
    True: "bool_and(r = least) OVER (PARTITION BY w, c) AND row_number() OVER (PARTITION BY w, c ORDER BY k) % 2 = 1",
    False: "k = min(CASE WHEN r = least THEN k END) OVER (PARTITION BY w)",
}

DECODE = """
SELECT d, string_agg(v.hex, '' ORDER BY i.p) AS hex
FROM ids_in i JOIN vocab v ON v.id = i.id GROUP BY d
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file."""
    with open(path, "rb") as f:
        raw = f.read(MOST_VOCAB_BYTES + 1)
    if len(raw) > MOST_VOCAB_BYTES:
        raise ValueError("the vocabulary is too large to send to every executor")
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, raw.splitlines()))}


def runs(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Places of neighbours that have so much together at most, or of one."""
    start = total = 0
    for i, size in enumerate(sizes):
        if i > start and total + size > most:
            yield start, i
            start, total = i, 0
        total += size
    if sizes:
        yield start, len(sizes)


class Codec:
    """Encodes and decodes with one vocabulary; lives in a worker process and keeps what it has learned of pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, share: int = 1):
        import duckdb
        import regex

        self.share = share
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.token = {r: token for token, r in ranks.items()}
        merges = np.array([(a, b, r) for token, r in ranks.items() for i in range(1, len(token)) if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None], np.int32)
        self.byte = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.by_length = sorted(ranks, key=len, reverse=True)
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1; SET memory_limit = '500MB'; SET temp_directory = ''")
        self.db.register("merges_in", pa.table({name: pa.array(merges[:, i]) for i, name in enumerate("abr")}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self.db.register("vocab_in", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "hex": [x.hex() for x in ranks]}))
        self.db.execute("CREATE TABLE vocab AS SELECT * FROM vocab_in")
        self.units: dict[str, int] = {}  # each unit's place in at and uses
        self.flat, self.uses = np.empty(0, np.int32), np.empty(0, np.int64)
        self.at = np.zeros(1, np.int64)

    def forget(self) -> None:
        """Keep the short units that were used most since they were learned, older uses counting half, and half of the most units at most."""
        sizes, most = np.diff(self.at), MOST_UNITS // self.share // 2
        uses = np.where(sizes <= SHORT_UNIT, self.uses, 0)
        kept = uses > max(1, np.partition(uses, -most - 1)[-most - 1] if len(uses) > most else 1)
        self.units = {u: i for i, u in enumerate(compress(self.units, kept))}
        self.flat, self.uses = self.flat[np.repeat(kept, sizes)], self.uses[kept] // 2
        self.at = np.concatenate([[0], np.cumsum(sizes[kept])])

    def recursive(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all pieces end to end, and how many each has."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        keys = np.repeat(np.arange(len(pieces), dtype=np.int64) * 256 - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        self.db.register("bytes_in", pa.table({"k": keys, "t": self.byte[np.frombuffer(b"".join(pieces), np.uint8)]}))
        found = self.db.sql(ENCODE).to_arrow_table().column("ids").combine_chunks()
        self.db.unregister("bytes_in")
        return found.flatten().to_numpy(), np.diff(found.offsets.to_numpy())

    @cached_property
    def regular(self) -> bool:
        """Whether every token is contracted from pairs of lower ranks than its own, so that no contraction makes a pair of lower rank."""
        for token, r in self.ranks.items():
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                least, i = min((self.ranks.get(a + b, NONE), i) for i, (a, b) in enumerate(zip(parts, parts[1:])))
                if least >= r:
                    return False
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return True

    def reach(self, piece: bytes) -> int:
        """How far, in bytes, pairs of lower rank matter to a pair of the piece."""
        if not self.regular:
            return len(piece)
        have = set(piece)
        return MARGIN * next((len(token) for token in self.by_length if have.issuperset(token) and token in piece), 1)

    def recursive_long(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As recursive, for pieces of any length."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        places = (np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        reach = np.fromiter(map(self.reach, pieces), np.int32, len(pieces))
        rows = {"w": np.repeat(np.arange(len(pieces), dtype=np.int32), lengths), "k": places, "t": self.byte[np.frombuffer(b"".join(pieces), np.uint8)], "reach": np.repeat(reach, lengths)}
        self.db.register("long_in", pa.table(rows))
        # A piece over LONG_BYTES is never cut, so the limit grows with it.
        self.db.execute(f"SET memory_limit = '{500 + int(lengths.sum()) // 500}MB'")
        found = self.db.sql(ENCODE_LONG.replace("CHOICE", CHOICE[self.regular])).to_arrow_table().column("ids").combine_chunks()
        self.db.execute("SET memory_limit = '500MB'")
        self.db.unregister("long_in")
        return found.flatten().to_numpy(), np.diff(found.offsets.to_numpy())

    def rank(self, a: int, b: int) -> int | None:
        """The rank of two tokens' concatenation."""
        return self.ranks.get(self.token[a] + self.token[b])

    def heap(self, piece: bytes) -> list[int]:
        """The same contraction of one piece in plain Python; no piece goes this way, tests hold the recursions against it."""
        ids = self.byte[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        queue = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:])) if (r := self.rank(a, b)) is not None]
        heapq.heapify(queue)
        while queue:
            r, i, a, b = heapq.heappop(queue)
            j = after[i]
            if j >= len(ids) or ids[i] != a or ids[j] != b:
                continue  # one of the two was contracted meanwhile
            ids[i], ids[j], k = r, -1, after[j]
            after[i] = k
            if k < len(ids):
                before[k] = i
                if (n := self.rank(r, ids[k])) is not None:
                    heapq.heappush(queue, (n, i, r, ids[k]))
            if (h := before[i]) >= 0 and (n := self.rank(ids[h], r)) is not None:
                heapq.heappush(queue, (n, h, ids[h], r))
        return [x for x in ids if x >= 0]

    def learn(self, units: list[str]) -> None:
        """Ids of new units."""
        cut = [self.pattern.findall(u) for u in units]
        number = {p: i for i, p in enumerate(dict.fromkeys(p for found in cut for p in found))}
        raw = [p.encode() for p in number]
        whole = [self.ranks.get(p, -1) for p in raw]
        short = [i for i, (p, r) in enumerate(zip(raw, whole)) if r < 0 and len(p) <= LONG_PIECE]
        long = [i for i, (p, r) in enumerate(zip(raw, whole)) if r < 0 and len(p) > LONG_PIECE]
        parts = [(np.array(whole, np.int32)[(w := np.array(whole)) >= 0], np.ones(int((w >= 0).sum()), np.int64))]
        step = max(1, ENCODE_PIECES // self.share)
        parts += [self.recursive([raw[i] for i in short[at : at + step]]) for at in range(0, len(short), step)]
        parts += [self.recursive_long([raw[i] for i in long[a:b]]) for a, b in runs([len(raw[i]) for i in long], LONG_BYTES // self.share)]
        # Pieces stand in that order in flat; place has where each begins.
        flat, sizes = np.concatenate([x for x, _ in parts]), np.concatenate([n for _, n in parts])
        order = np.concatenate([np.flatnonzero(w >= 0), np.array(short + long, np.int64)]).astype(np.int64)
        size, place = np.empty(len(raw), np.int64), np.empty(len(raw), np.int64)
        size[order], place[order] = sizes, np.cumsum(sizes) - sizes
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        own = np.fromiter((number[p] for found in cut for p in found), np.int64, int(counts.sum()))
        each = size[own]
        ends = np.cumsum(each)
        self.flat = np.concatenate([self.flat, flat[np.arange(ends[-1]) + np.repeat(place[own] - ends + each, each)]])
        self.at = np.concatenate([self.at, self.at[-1] + ends[np.cumsum(counts) - 1]])
        first = len(self.units)
        self.units.update(zip(units, range(first, first + len(units))))
        self.uses = np.concatenate([self.uses, np.zeros(len(units), np.int64)])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.LargeStringArray]:
        """Flat ids, the number of each text, and each text's decimal ids joined by one space."""
        if len(self.units) > MOST_UNITS // self.share or len(self.flat) > MOST_IDS // self.share:
            self.forget()
        cut = [UNIT.findall(t) for t in texts]
        known = self.units
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        every = np.fromiter(map(known.get, chain.from_iterable(cut), repeat(-1)), np.int64, int(counts.sum()))
        missing = every < 0
        missed = list(compress(chain.from_iterable(cut), missing.tolist()))
        del cut
        if missed:
            self.learn(list(dict.fromkeys(missed)))
            every[missing] = np.fromiter(map(known.__getitem__, missed), np.int64, len(missed))
        self.uses += np.bincount(every, minlength=len(self.uses))
        sizes = self.at[every + 1] - self.at[every]
        ends = np.cumsum(sizes)
        flat = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.at[every] - (ends - sizes), sizes)]
        text_ends = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])]
        said = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(text_ends), pa.array(flat).cast(pa.large_string())), pa.scalar(" ", pa.large_string()))
        return flat, np.diff(text_ends), said

    def decode(self, flat: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each run of ids. A long text is decoded in several runs of the query."""
        out: list[bytes] = []
        first, start = 0, 0
        while first < len(counts):
            last, rows = first + 1, int(counts[first])
            while last < len(counts) and rows + counts[last] <= DECODE_ROWS // self.share:
                rows += int(counts[last])
                last += 1
            self.db.register("ids_in", pa.table({"d": np.repeat(np.arange(last - first), counts[first:last]), "p": np.arange(rows), "id": flat[start : start + rows]}))
            found = dict(self.db.execute(DECODE).fetchall())
            self.db.unregister("ids_in")
            out += [bytes.fromhex(found.get(i, "")) for i in range(last - first)]
            first, start = last, start + rows
        return out


def codec(ranks: dict[bytes, int], pattern: str, name: bytes, share: int = 1) -> Codec:
    kept = keep("bpe")
    if name not in kept:
        kept.clear()
        kept[name] = Codec(ranks, pattern, share)
    return kept[name]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, share: int = 1) -> DataFrame:
    """Per row: id, n_tokens, ids_sha256, decoded_sha256 (of the bytes that decoding the ids gives), and the ids if asked for. share divides the bounds of what a worker holds."""
    bound_batches(docs.sparkSession, max(1, BATCH_BYTES // share))
    ranks = read_ranks(path)
    name = hashlib.sha256(repr((sorted(ranks.values())[-1], len(ranks), path, pattern, share)).encode()).digest()
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    fields = [T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(sent.value, pattern, name, share)
        for batch in batches:
            for part in slices(batch, 1, max(1, SLICE_CHARS // share), batch.num_rows):
                texts = [t or "" for t in part.column(1).to_pylist()]
                flat, counts, joined = own.encode(texts)
                decoded = own.decode(flat, counts)
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array([hashlib.sha256(x.as_py().encode()).hexdigest() for x in joined]), pa.array([hashlib.sha256(x).hexdigest() for x in decoded])]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, names=[f.name for f in fields])
            hand_back()

    return docs.select(id_col, text_col).mapInArrow(run, T.StructType(fields))
