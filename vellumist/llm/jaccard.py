"""N-gram Jaccard join by grouped prefixes.

A document is the set of hashes of its word shingles. Two sets of Jaccard similarity t share a shingle among the first
n - ceil(t n) + 1 of each, whatever common order the shingles have. Here rare shingles come first, so a document most of
whose shingles occur nowhere else has nothing to offer and leaves at once.

1. Shingles (NumPy over Arrow batches): a block of documents becomes sorted packed runs of hashes, dealt to hash
   buckets. A bucket counts each hash over all blocks and answers with those that occur more than once; hashes that are
   frequent within one block are counted there and travel once per block, so no hash makes a large bucket.
2. Each block orders its documents' shared shingles by frequency and drops documents whose prefix holds none.
3. Equal sets collapse into a class; classes with equal size and prefix collapse into a group. Groups meet in the buckets
   of their prefix shingles, size and position filters drop group pairs, and the rest expand into member pairs, verified exactly.
4. Links are wanted as connected classes, so pairs of one component need no further test. Rounds of leaders come first: each group
   is tested against a leader of its buckets, one pair a member, and buckets that are all connected leave. What still shares a bucket across components is dealt to cells,
   the buckets led by one component. A cell's members are tested in one task, or in blocks of two parts of bounded size where there are
   more, and parts of one component never meet. Tasks give the links that merge components, never pairs. Nothing is capped or sampled.

Words of up to seven bytes are hashed one to one (their bytes and length, mixed), longer ones by keyed SipHash, and a shingle chains its words' hashes
through multiplications and shifts, so no two texts collide by their structure. Hashes have 64 bits for set sizes and classes (with two 64-bit
sums over the set) and 48 bits within the join. "Exactly" means up to these: of two verified texts of n shingles, two different shingles share a hash
with a probability of about n * n / 2**48 (7e-11 for 140 words, 1e-6 for 20,000), and only pairs within that of the threshold could be judged otherwise.

Defined cases: a text without words has the empty set and links with nothing; rows without an id link with nothing and have
a null component; rows that repeat an id are compared each for themselves; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellumist.llm.batches import bound_batches, hand_back, keep
from vellumist.llm.components import components
from vellumist.runtime import materialize

WORDS = 5
PERCENT = 75
BLOCK_BYTES = 4_000_000
#: Shingle occurrences that a bucket holds, on average.
BUCKET_TOKENS = 1_500_000
#: A hash in so many documents of a block is counted in the block.
LOCAL_HOT = 8
BITS = 48
#: Rounds of leaders before the cells, which are exact whatever the rounds have left.
ROUNDS = 3
#: Bytes of sets in one part of a cell.
PART_BYTES = 4_000_000

DEALT = "dest long, kind int, blk long, payload binary"
ANSWER = "blk long, kind int, payload binary"
SETS = "id long, n long, d1 long, d2 long, npre int, single int, toks array<long>"

_u = np.uint64
#: Odd multipliers from the fractional part of the golden ratio, by repeated multiplication.
_G = _u(0x9E3779B97F4A7C15)
_ODD = [_u(pow(0x9E3779B97F4A7C15, k, 1 << 64) | 1) for k in range(1, 8)]


def mix(x: np.ndarray, k: int = 0) -> np.ndarray:
    x = (x ^ (x >> _u(31))) * _ODD[k]
    x = (x ^ (x >> _u(29))) * _ODD[k + 1]
    return x ^ (x >> _u(32))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.ones(256, dtype=bool)
_WORD[[9, 10, 11, 12, 13, 32]] = False
#: Bytes of words that a 64-bit number holds beside their count.
PLAIN = 7
_MASK = np.array([(1 << 8 * n) - 1 for n in range(PLAIN + 1)], dtype=_u)
SIP_KEY = "vellumist-words!"


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte runs: one to one up to PLAIN bytes, keyed SipHash beyond."""
    sizes = ends - starts
    padded = np.append(data, np.zeros(8, np.uint8))
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    short = np.minimum(sizes, PLAIN)
    out = mix((eight[starts] & _MASK[short]) | (short.astype(_u) << _u(56)))
    long = np.flatnonzero(sizes > PLAIN)
    if len(long):
        raw = data.tobytes()
        words = np.empty(len(long), object)
        words[:] = [raw[i:j] for i, j in zip(starts[long].tolist(), ends[long].tolist())]
        out[long] = pd.util.hash_array(words, hash_key=SIP_KEY)
    return out


def _chain(h: np.ndarray, word: np.ndarray) -> np.ndarray:
    h = (h ^ word) * _ODD[6]
    return h ^ (h >> _u(29))


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct (hash, document) of the k-word shingles of texts, given as one buffer of UTF-8 bytes and its offsets."""
    docs = len(offsets) - 1
    data = _LOWER[data[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    if not len(data):
        return np.empty(0, _u), np.empty(0, np.int64)
    word = _WORD[data]
    first, last = word.copy(), word.copy()
    first[1:] &= ~word[:-1]
    last[:-1] &= ~word[1:]
    inner = offsets[1:-1]
    edges = inner[(inner > 0) & (inner < len(data))]
    first[edges] = word[edges]
    last[edges - 1] = word[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    if not len(starts):
        return np.empty(0, _u), np.empty(0, np.int64)
    words = word_hashes(data, starts, ends)
    owner = np.searchsorted(offsets, starts, "right") - 1
    count = np.bincount(owner, minlength=docs)
    h = np.zeros(max(0, len(words) - k + 1), _u)
    for i in range(k):
        h = _chain(h, words[i : i + len(h)])
    whole = owner[: len(h)] == owner[k - 1 :] if len(h) else np.empty(0, bool)
    h, own = mix(h[whole]), owner[: len(h)][whole]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        at = np.concatenate([[0], np.cumsum(count)])
        few = np.zeros(len(short), _u)
        for i in range(k - 1):
            has = count[short] > i
            few[has] = _chain(few[has], words[at[short][has] + i])
        h, own = np.concatenate([h, mix(few + count[short].astype(_u), 3)]), np.concatenate([own, short])
        resort = np.argsort(own, kind="stable")
        h, own = h[resort], own[resort]
    order = np.argsort(h, kind="stable")
    h, own = h[order], own[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (own[1:] != own[:-1])
    return h[fresh], own[fresh]


def _sum64(h: np.ndarray, own: np.ndarray, docs: int) -> np.ndarray:
    """Sums of hashes by document modulo 2**64; halves stay exact in doubles up to two million shingles a text, and beyond by parts."""
    out = np.zeros(docs, _u)
    for i in range(0, len(h), 1 << 21):
        low = np.bincount(own[i : i + (1 << 21)], (h[i : i + (1 << 21)] & _u(0xFFFFFFFF)).astype(np.float64), docs).astype(_u)
        high = np.bincount(own[i : i + (1 << 21)], (h[i : i + (1 << 21)] >> _u(32)).astype(np.float64), docs).astype(_u)
        out += low + (high << _u(32))
    return out


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays one after another, each with its type and length."""
    return b"".join(part for a in arrays for part in (a.dtype.str.encode().ljust(4), len(a).to_bytes(8, "little"), a.tobytes()))


def unpack(raw: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(raw):
        kind, n = np.dtype(raw[at : at + 4].decode().strip()), int.from_bytes(raw[at + 4 : at + 12], "little")
        out.append(np.frombuffer(raw, kind, n, at + 12))
        at += 12 + n * kind.itemsize
    return out


def narrow(x: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest unsigned type."""
    top = int(x.max(initial=0))
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def bucket_of(token: np.ndarray, buckets: int) -> np.ndarray:
    """Number of the hash bucket, not falling with the token."""
    return ((token >> _u(BITS - 32)) * _u(buckets)) >> _u(32)


def deal(buckets: int, k: int):
    """mapInArrow function: texts to bucket runs and block headers (DEALT)."""

    def rows_of(batch: pa.RecordBatch, blk: int) -> Iterator[tuple[int, int, int, bytes]]:
        text = batch.column(1)
        text = text.fill_null("") if text.null_count else text
        offsets = np.frombuffer(text.buffers()[1], np.int32, len(text) + 1, text.offset * 4).astype(np.int64)
        data = np.frombuffer(text.buffers()[2], np.uint8) if text.buffers()[2] else np.empty(0, np.uint8)
        h, own = shingles(data, offsets, k)
        docs = batch.num_rows
        n = np.bincount(own, minlength=docs)
        sums = [_sum64(mix(h, i), own, docs) for i in (0, 3)]
        ids = batch.column(0)
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        head = [ids.fill_null(0).to_numpy().astype(np.int64), known, narrow(n), *sums]
        alive = known[own]  # rows without an id link with nothing
        token, own = h[alive] >> _u(64 - BITS), own[alive]
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        at = np.flatnonzero(new)
        token, count = token[at], np.diff(np.append(at, len(own)))
        hot = np.repeat(count >= LOCAL_HOT, count)
        head += [token[count >= LOCAL_HOT], narrow(count[count >= LOCAL_HOT]), narrow(own[hot])]
        yield buckets + blk % buckets, 1, blk, pack(*head)
        ends = np.append(0, np.cumsum(np.where(count >= LOCAL_HOT, 0, count)))
        cold = own[~hot]
        bucket = bucket_of(token, buckets)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        for i, j in zip([0, *cuts], [*cuts, len(token)] if len(token) else []):  # only buckets that the block has tokens for
            yield int(bucket[i]), 0, blk, pack(token[i : i + 1], narrow(np.diff(token[i:j])), narrow(count[i:j]), narrow(cold[ends[i] : ends[j]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        keep()
        blk = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            at = 0
            while at < batch.num_rows:
                upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + BLOCK_BYTES, "right")))
                rows = list(rows_of(batch.slice(at, upto - at), blk))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], names=["dest", "kind", "blk", "payload"])
                at, blk = upto, blk + 1
        hand_back()

    return run


def count_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """Counts the hashes of a bucket over all blocks; answers each block with those that occur more than once (ANSWER)."""
    keep()
    heads, runs = rows[rows["kind"] == 1], rows[rows["kind"] == 0]
    out = [(b, 1, p) for b, p in zip(heads["blk"], heads["payload"])]
    parts = [unpack(p) for p in runs["payload"]]
    if parts:
        tokens = [np.concatenate([first, first + np.cumsum(steps.astype(_u))]) for first, steps, _, _ in parts]
        seen = np.concatenate(tokens)
        counts = np.concatenate([c for _, _, c, _ in parts]).astype(np.int64)
        order = np.argsort(seen, kind="stable")
        at = np.flatnonzero(np.append(True, seen[order][1:] != seen[order][:-1]))
        df = np.empty(len(seen), np.int64)
        df[order] = np.repeat(np.add.reduceat(counts[order], at), np.diff(np.append(at, len(seen))))
        start = 0
        for blk, token, (_, _, count, own) in zip(runs["blk"], tokens, parts):
            d = df[start : start + len(token)]
            start += len(token)
            many, hot = d > 1, count >= LOCAL_HOT
            cold = np.repeat(many[~hot], count[~hot])
            left = many & ~hot
            if many.any():
                out.append((blk, 0, pack(token[left], narrow(d[left]), narrow(count[left]), narrow(own[cold]), token[hot], narrow(d[hot]))))
    hand_back()
    return pd.DataFrame(out, columns=["blk", "kind", "payload"])


def order_block(percent: int):
    """Function of a block's header and answers: the documents' sets (SETS)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        ids, known, n, d1, d2, hot, hot_count, hot_own = unpack(rows.loc[rows["kind"] == 1, "payload"].iloc[0])
        known, n = known.astype(bool), n.astype(np.int64)
        hot_at = np.append(0, np.cumsum(hot_count.astype(np.int64)))
        tokens, dfs, owns = [np.empty(0, _u)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for raw in rows.loc[rows["kind"] == 0, "payload"]:
            token, df, count, own, hot_token, hot_df = unpack(raw)
            i = np.searchsorted(hot, hot_token)
            each = hot_count.astype(np.int64)[i]
            ends = np.cumsum(each)
            tokens.append(np.repeat(hot_token, each))
            dfs.append(np.repeat(hot_df.astype(np.int64), each))
            owns.append(hot_own[np.arange(ends[-1] if len(ends) else 0) + np.repeat(hot_at[i] - ends + each, each)].astype(np.int64))
            tokens.append(np.repeat(token, count))
            dfs.append(np.repeat(df.astype(np.int64), count))
            owns.append(own.astype(np.int64))
        token, df, own = np.concatenate(tokens), np.concatenate(dfs), np.concatenate(owns)
        order = np.lexsort((token, df, own))
        token, shared = token[order].astype(np.int64), np.bincount(own, minlength=len(ids))
        prefix = n - -(-percent * n // 100) + 1
        visible = np.where((n > 0) & known, np.maximum(0, prefix - (n - shared)), 0)
        ends = np.cumsum(shared)
        lists = [token[e - s : e] if v else None for e, s, v in zip(ends, shared, visible)]
        return pd.DataFrame(
            {"id": pd.array(np.where(known, ids, 0), "Int64").copy(), "n": n, "d1": d1.view(np.int64), "d2": d2.view(np.int64), "npre": visible.astype(np.int32), "single": (n - shared).astype(np.int32), "toks": lists}
        ).assign(id=lambda x: x["id"].mask(~known))

    return run


def sets(docs: DataFrame, id_col: str, text_col: str, k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """SETS of every row: size, digests, and the shared shingles, rare first, where the prefix holds any."""
    bound_batches(docs.sparkSession)
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    size = plain.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, ceil(size / 7 / BUCKET_TOKENS))
    dealt = plain.mapInArrow(deal(buckets, k), DEALT)
    answers = dealt.groupBy("dest").applyInPandas(count_bucket, ANSWER)
    return answers.groupBy("blk").applyInPandas(order_block(percent), SETS)


def verify(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of class ids whose sets are similar enough. Shingles that only one text has are in no intersection."""
    own = classes.select("cid", "n", "toks")
    left = own.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta"))
    right = own.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb"))
    both = pairs.join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("ta", "tb"))
    return both.filter(100 * common >= percent * (F.col("na") + F.col("nb") - common)).select("a", "b")


def _sizes_fit(na, nb, percent: int):
    return 100 * F.least(na, nb) >= percent * F.greatest(na, nb)


class _Links:
    """Connected classes so far, as labels (cid, comp)."""

    def __init__(self) -> None:
        self.labels: DataFrame | None = None

    def label(self, df: DataFrame, col: str, out: str) -> DataFrame:
        if self.labels is None:
            return df.withColumn(out, F.col(col))
        return df.join(self.labels.select(F.col("cid").alias(col), F.col("comp").alias(out)), col, "left").withColumn(out, F.coalesce(out, col))

    def merge(self, edges: DataFrame) -> None:
        """Connect the classes of edges (a, b)."""
        apart = self.label(self.label(edges, "a", "ca"), "b", "cb").filter("ca != cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
        merged = components(apart)
        if not merged.limit(1).count():
            return
        if self.labels is None:
            self.labels = merged.select(F.col("node").alias("cid"), "comp")
        else:
            moved = self.labels.join(merged.select(F.col("node").alias("comp"), F.col("comp").alias("to")), "comp", "left").select("cid", F.coalesce("to", "comp").alias("comp"))
            fresh = merged.join(self.labels, merged["node"] == self.labels["cid"], "left_anti").select(F.col("node").alias("cid"), merged["comp"])
            self.labels = materialize(moved.unionByName(fresh), "join-labels")


def _ordered(df: DataFrame, x: str, y: str) -> DataFrame:
    return df.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b")).filter("a != b")


def link(classes: DataFrame, percent: int = PERCENT) -> DataFrame | None:
    """Labels (cid, comp) of classes (cid, n, npre, single, toks) that links reach; None if there are none."""
    grouped = classes.select("cid", "n", "single", F.slice("toks", F.lit(1), F.col("npre")).alias("prefix"))
    grouped = materialize(grouped.withColumn("gid", F.min("cid").over(Window.partitionBy("n", "single", "prefix"))), "join-groups")
    members = grouped.select("gid", "cid")
    # A row for each group and shingle of its prefix, where another group has it too.
    rows = grouped.filter("gid = cid").select("gid", "n", F.explode("prefix").alias("tok"))
    shared = rows.groupBy("tok").agg(F.count(F.lit(1)).alias("m")).filter("m > 1").select("tok")
    rows = materialize(rows.join(shared, "tok").withColumn("comp", F.col("gid")), "join-prefixes")
    links = _Links()
    inside = _ordered(members.filter("gid != cid"), "gid", "cid")
    torn = torn_tokens = None
    for seed in range(ROUNDS):
        # A bucket's leader is its group of least hash; each group meets the least leader that is of another component.
        by_hash = F.struct(F.xxhash64(F.lit(seed), "gid").alias("h"), "gid", "n", "comp")
        best = rows.groupBy("tok").agg(F.min(by_hash).alias("l"))
        met = rows.join(best, "tok").filter((F.col("comp") != F.col("l.comp")) & _sizes_fit(F.col("n"), F.col("l.n"), percent)).groupBy("gid").agg(F.min("l").alias("l"))
        pairs = _ordered(met.select("gid", F.col("l.gid").alias("leader")).join(members, "gid"), "leader", "cid")
        pairs = pairs.unionByName(inside) if seed == 0 else pairs
        links.merge(materialize(verify(materialize(pairs.distinct(), "join-pairs"), classes, percent), "join-links"))
        # Buckets whose groups are all connected are done, but for groups whose members are in several components.
        labelled = links.label(rows.drop("comp"), "gid", "comp")
        mixed = labelled.groupBy("tok").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo != hi").select("tok")
        if torn is None:
            parts = links.label(members, "cid", "comp").groupBy("gid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
            torn = materialize(parts.filter("lo != hi").select("gid"), "join-torn")
            torn_tokens = materialize(rows.join(torn, "gid", "left_semi").select("tok").distinct(), "join-open")
        rows = materialize(labelled.join(mixed.unionByName(torn_tokens).distinct(), "tok").select("tok", "gid", "n", "comp"), "join-prefixes")
    # A torn group is a bucket of its own, under a number that prefix shingles (48 bits) rarely have; if one has, both are one bucket.
    own = members.join(torn, "gid", "left_semi").select(F.xxhash64(F.lit("group"), "gid").alias("tok"), "cid")
    left = links.label(rows.join(members, "gid").select("tok", "cid").unionByName(own), "cid", "comp")
    links.merge(materialize(test_cells(materialize(left, "join-open-buckets"), classes, percent), "join-links"))
    return links.labels


def test_cells(left: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect all similar members (tok, cid, comp) of each bucket that are of different components."""
    lead = left.groupBy("tok").agg(F.min(F.struct(F.xxhash64("comp"), "comp")).alias("l")).select("tok", F.col("l.comp").alias("cell"))
    cells = left.join(lead, "tok").groupBy("cell", "cid").agg(F.min("comp").alias("comp"), F.collect_set("tok").alias("open"))
    cells = materialize(cells.join(classes.select("cid", "n", "toks"), "cid").withColumn("bytes", 8 * (F.size("toks") + F.size("open"))), "join-cells")
    # Parts of a cell: those of its largest component, which need not meet each other, then the others.
    sizes = cells.groupBy("cell", "comp").agg(F.sum("bytes").alias("bytes"))
    sizes = sizes.groupBy("cell").agg(F.max_by("comp", "bytes").alias("main"), F.max("bytes").alias("most"), F.sum("bytes").alias("total"), F.count(F.lit(1)).alias("comps")).filter("comps > 1")
    sizes = materialize(sizes, "join-cell-sizes")
    small = sizes.filter(F.col("total") <= PART_BYTES).agg(F.sum("total")).first()[0] or 0
    bins = max(1, ceil(small / PART_BYTES))
    parts = [F.ceil(F.col(c) / PART_BYTES).cast("int") for c in ("most", "rest")]
    dealt = cells.join(sizes.withColumn("rest", F.col("total") - F.col("most")), "cell").withColumns({"c1": parts[0], "c2": parts[1]})
    one = F.col("total") <= PART_BYTES
    part = F.when(one, 0).when(F.col("comp") == F.col("main"), F.pmod(F.xxhash64("cid"), "c1")).otherwise(F.col("c1") + F.pmod(F.xxhash64("cid"), "c2")).cast("int")
    dealt = dealt.withColumn("part", part)
    block = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))
    last, me = F.col("c1") + F.col("c2") - 1, F.col("part")
    ahead = F.when(F.greatest(me + 1, "c1") <= last, F.transform(F.sequence(F.greatest(me + 1, "c1"), last), lambda j: block(me, j))).otherwise(F.expr("array()"))
    behind = F.when(me >= F.col("c1"), F.transform(F.sequence(F.lit(0), me), lambda i: block(i, me))).otherwise(F.expr("array()"))
    blocks = F.when(one, F.array(block(F.lit(0), F.lit(0)))).otherwise(F.concat(ahead, behind))
    job = F.when(one, F.pmod(F.xxhash64("cell"), F.lit(bins))).otherwise(F.lit(-1))
    dealt = dealt.select(job.alias("job"), F.when(one, 0).otherwise(F.col("cell")).alias("of"), "cell", F.explode(blocks).alias("at"), "part", "cid", "comp", "n", "toks", "open")
    dealt = dealt.select("job", "of", F.col("at.lo").alias("lo"), F.col("at.hi").alias("hi"), "cell", "part", "cid", "comp", "n", "toks", "open")
    return dealt.groupBy("job", "of", "lo", "hi").applyInPandas(test_block(percent), "a long, b long")


def test_block(percent: int):
    """Function of the members of one block: a link for each two components that some similar pair connects."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        if (rows["lo"].iloc[0] != rows["hi"].iloc[0]) and rows["part"].nunique() == 1:
            return pd.DataFrame({"a": np.empty(0, np.int64), "b": np.empty(0, np.int64)})
        within = rows["lo"].iloc[0] == rows["hi"].iloc[0]
        cid, n, part = (rows[c].to_numpy() for c in ("cid", "n", "part"))
        root = np.unique(rows["comp"].to_numpy(), return_inverse=True)[1]
        size = np.fromiter(map(len, rows["toks"]), np.int64, len(rows))
        at = np.cumsum(size) - size
        flat = np.unique(np.concatenate(rows["toks"].to_list()), return_inverse=True)[1]
        # Buckets: members by (cell, open shingle).
        opened = np.fromiter(map(len, rows["open"]), np.int64, len(rows))
        cell = np.unique(rows["cell"].to_numpy(), return_inverse=True)[1]
        keys = np.unique(np.stack([np.repeat(cell, opened), np.unique(np.concatenate(rows["open"].to_list()), return_inverse=True)[1]]), axis=1, return_inverse=True)[1].ravel()
        by_key = np.argsort(keys, kind="stable")
        holders = np.split(np.repeat(np.arange(len(rows)), opened)[by_key], np.flatnonzero(np.diff(keys[by_key])) + 1)
        own = np.split(keys, np.cumsum(opened)[:-1])
        mark, links = np.zeros(int(flat.max(initial=-1)) + 1, bool), []
        for x in range(len(rows)) if within else np.flatnonzero(part == rows["hi"].iloc[0]):
            met = np.zeros(len(rows), bool)
            for key in own[x]:
                met[holders[key]] = True
            if within:
                met[: x + 1] = False
            else:
                met &= part != part[x]
            met &= root != root[x]
            y = np.flatnonzero(met)
            need = -(-percent * (n[x] + n[y]) // (100 + percent))
            y = y[np.minimum(size[x], size[y]) >= need]
            if not len(y):
                continue
            mark[flat[at[x] : at[x] + size[x]]] = True
            ends = np.cumsum(size[y])
            hits = np.add.reduceat(mark[flat[np.arange(ends[-1]) + np.repeat(at[y] - ends + size[y], size[y])]].astype(np.int64), ends - size[y])
            mark[flat[at[x] : at[x] + size[x]]] = False
            for z in y[100 * hits >= percent * (n[x] + n[y] - hits)]:
                if root[z] != root[x]:
                    links.append((cid[x], cid[z]))
                    root[root == root[z]] = root[x]
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return run


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Per row: id, n_shingles, class_id (smallest id of the equal set), component_id (smallest id that links reach)."""
    every = materialize(sets(docs, id_col, text_col, k, percent), "join-sets")
    key = ["n", "d1", "d2"]
    one = every.filter("npre > 0").groupBy(*key).agg(F.min("id").alias("cid"), F.min_by(F.struct("npre", "single", "toks"), "id").alias("s"))
    classes = materialize(one.select(*key, "cid", "s.*"), "join-classes")
    labels = link(classes, percent)
    named = classes.select(*key, "cid")
    named = named.withColumn("comp", F.col("cid")) if labels is None else named.join(labels, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    named = materialize(named, "join-named")
    rows = every.select("id", *key, (F.col("npre") > 0).alias("open")).join(named.withColumn("open", F.lit(True)), [*key, "open"], "left")
    return rows.select("id", F.col("n").alias("n_shingles"), F.coalesce("cid", "id").alias("class_id"), F.coalesce("comp", "id").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with one document of each component: the one with the smallest id.

    Rows without an id stay. Rows that repeat id and text become one; rows that share an id with other texts stay or go together, and go
    if every one of them is a copy of another document.
    """
    linked = materialize(join(docs, id_col, text_col, **options).filter("id is not null").select("id", "component_id"), "join-linked")
    if linked.groupBy("id").count().filter("count > 1").limit(1).count():
        named, unnamed = docs.filter(F.col(id_col).isNotNull()), docs.filter(F.col(id_col).isNull())
        docs = named.dropDuplicates([id_col, text_col]).unionByName(unnamed)
    gone = materialize(linked.groupBy("id").agg(F.min(F.col("component_id") != F.col("id")).alias("copy")).filter("copy").select(F.col("id").alias("__gone")), "join-gone")
    return docs.join(gone, F.col(id_col).cast("long") == F.col("__gone"), "left_anti")
