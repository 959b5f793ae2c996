"""Secret scans with multipart credential linking (JVM functions only).

Strong spans, which are always reported, follow three fixed patterns (assign, access, hex). Weak candidates
are parts that alone mean little: a user or client identifier or a truncated access id (``weak_access``),
a short assignment value, a 16 to 23 digit hex run or a mixed-class token (``weak_secret``).

Parts, strong or weak, are linked: an access part (``access``, ``weak_access``) and a secret part (the others) make a link when they do not
overlap and fewer than ``SCOPE`` code points lie between them. Links whose extents overlap are one multipart credential; endpoints (URLs and host
assignments) in its scope belong to it as context, but are not spans of their own and decide nothing. A weak candidate is reported when it has a link.

Both links and endpoints come from one interval join: one side is dealt to position bins of its document, the other to the bins that its scope
touches, and a pair is made in the first bin that both have, so it comes once. Parts of a kind do not overlap, so each meets a bounded number of others
beside those that it covers. Positions count code points; ends are exclusive.

Defined cases: a null or empty text has no spans; rows that repeat doc_id and text give the same result each;
rows that repeat only doc_id are told apart by a hash of the text; an empty table gives an empty result; other
columns are ignored (or kept as they are by ``redact``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellumist.runtime import materialize

# Fixed by the contract.
ASSIGN = r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{24,}"
STRONG_KINDS = ("assign", "access", "hex")

WEAK_USER = r"""(?i)\b(?:user(?:_?name)?|login|client_?id|account_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})"""
SHORT_HEX = r"(?<![0-9a-f])[0-9a-f]{16,23}(?![0-9a-f])"
# Each class is looked for over the whole token.
MIXED = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])(?=[a-z0-9+/_-]*+[A-Z])(?=[A-Z0-9+/_-]*+[a-z])[A-Za-z0-9+/_-]{20,}+"
ENDPOINT = r"""(?i)\b(?:https?|ftp|s3|jdbc:[a-z]+|postgres(?:ql)?|mongodb|redis|amqp)://[^\x20\x09-\x0D"'<>]+|\b(?:host|endpoint|server|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{4,}"""
SCOPE, BIN = 200, 512
#: Matches of a text that are put in order together.
RUN = 256
#: Order of the kinds at one start.
KINDS = (*STRONG_KINDS, "weak_access", "weak_secret", "endpoint")

SPAN = "struct<start:int,rank:int,end:int,kind:string>"
NOTHING = f"cast(array() as array<{SPAN}>)"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def _hits(text: Column, pattern: str, kind: str) -> Column:
    """Spans of pattern's matches in order: split() gives what lies between them, so lengths give positions.

    The running position goes over runs of ``RUN`` matches, then within each, so that a text of many matches does not copy its list for each.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    rank = KINDS.index(kind)
    parts = F.zip_with(F.split(text, pattern, -1), whole, lambda a, b: F.struct(F.length(a).alias("gap"), F.length(b).alias("len")))

    def span(at, n):
        return F.struct(at.alias("start"), F.lit(rank).alias("rank"), (at + n).cast("int").alias("end"), F.lit(kind).alias("kind"))

    def within(run, first):
        start = F.struct(first.alias("pos"), F.expr(NOTHING).alias("out"))

        def step(acc, x):
            at = acc["pos"] + x["gap"]
            out = F.when(x["len"].isNotNull(), F.concat(acc["out"], F.array(span(at, x["len"])))).otherwise(acc["out"])
            return F.struct((at + F.coalesce(x["len"], F.lit(0))).alias("pos"), out.alias("out"))

        return F.aggregate(run, start, step, lambda acc: acc["out"])

    def firsts(runs):
        start = F.struct(F.lit(0).alias("pos"), F.expr("cast(array() as array<int>)").alias("out"))

        def step(acc, run):
            size = F.aggregate(run, F.lit(0), lambda n, x: n + x["gap"] + F.coalesce(x["len"], F.lit(0)))
            return F.struct((acc["pos"] + size).alias("pos"), F.concat(acc["out"], F.array(acc["pos"])).alias("out"))

        return F.aggregate(runs, start, step, lambda acc: acc["out"])

    def cut(p):
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / RUN)), lambda i: F.slice(p, i * RUN + 1, RUN))

    found = _let(parts, lambda p: F.when(F.size(p) <= RUN, within(p, F.lit(0))).otherwise(_let(cut(p), lambda runs: F.flatten(F.zip_with(runs, firsts(runs), within)))))
    return F.when(text.rlike(pattern), found).otherwise(F.expr(NOTHING))


def _flat(*arrays: Column) -> Column:
    return F.array_sort(F.concat(*arrays))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, base, weak, context): spans of every text; no text is kept."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("id"), row_key(F.col(id_col), F.col(text_col)).alias("key"), text.alias("text"))
    df = df.select(
        "id", "key",
        _values(F.col("text"), ASSIGN, "assign", 1).alias("assigned"),
        _hits(F.col("text"), ACCESS, "access").alias("accessed"),
        _hits(F.col("text"), HEX, "hex").alias("hexes"),
        _hits(F.col("text"), WEAK_USER, "weak_access").alias("users"),
        _hits(F.col("text"), SHORT_HEX, "weak_secret").alias("short_hex"),
        _hits(F.col("text"), MIXED, "weak_secret").alias("mixed"),
        _hits(F.col("text"), ENDPOINT, "endpoint").alias("context"),
    )
    strong_assign = F.transform(F.filter("assigned", lambda x: x["val"] >= 6), lambda x: x["span"])
    weak_assign = F.transform(F.filter("assigned", lambda x: x["val"] < 6), lambda x: _as(x["span"], "weak_secret"))
    long_access = F.filter("accessed", lambda x: x["end"] - x["start"] >= 20)
    short_access = F.transform(F.filter("accessed", lambda x: x["end"] - x["start"] < 20), lambda x: _as(x, "weak_access"))
    df = df.select("id", "key", _flat(strong_assign, long_access, F.col("hexes")).alias("base"), _flat(weak_assign, short_access, F.col("users"), F.col("short_hex"), F.col("mixed")).alias("weak"), "context")
    # What a strong span covers is no candidate of its own.
    covered = F.filter("weak", lambda w: ~F.exists("base", lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))
    return df.withColumn("weak", F.when(F.size("weak") > 0, covered).otherwise(F.col("weak")))


def _as(span: Column, kind: str) -> Column:
    return F.struct(span["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), span["end"].alias("end"), F.lit(kind).alias("kind"))


def _values(text: Column, pattern: str, kind: str, group: int) -> Column:
    """As _hits, with the length of a group: array<struct<span, val>>."""
    spans = _hits(text, pattern, kind)
    lengths = F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
    zipped = F.zip_with(spans, lengths, lambda s, n: F.struct(s.alias("span"), n.alias("val")))
    return F.when(text.rlike(pattern), zipped).otherwise(F.expr(f"cast(array() as array<struct<span:{SPAN},val:int>>)"))


def row_key(doc_id: Column, text: Column) -> Column:
    return F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("null")), F.xxhash64(text).cast("string"))


def _near(parts: DataFrame, others: DataFrame) -> DataFrame:
    """(key, p, q) for the parts p and others q of a key with fewer than SCOPE code points between them, each pair once. Both: key, p."""

    def binned(at: Column) -> Column:
        return F.floor(at / BIN)

    first = binned(F.greatest(F.lit(0), F.col("p.start") - SCOPE))
    parts = parts.withColumn("first", first).withColumn("bin", F.explode(F.sequence("first", binned(F.col("p.end") + SCOPE))))
    others = others.select(F.col("key").alias("k"), F.col("p").alias("q")).withColumn("b", F.explode(F.sequence(binned(F.col("q.start")), binned(F.col("q.end") - 1))))
    apart = (F.col("q.start") < F.col("p.end") + SCOPE) & (F.col("q.end") > F.col("p.start") - SCOPE)
    once = F.col("bin") == F.greatest(F.col("first"), binned(F.col("q.start")))
    # Exploded bins are more than Spark takes them for, so neither side may be broadcast.
    return parts.join(others.hint("merge"), (F.col("key") == F.col("k")) & (F.col("bin") == F.col("b")) & apart & once).select("key", "p", "q")


def _secret(span: Column) -> Column:
    return span["kind"].isin("assign", "hex", "weak_secret")


def links(scanned: DataFrame) -> DataFrame:
    """(key, p, q): every access part p and secret part q, strong or weak, that do not overlap and share a scope."""
    rows = scanned.select("key", F.concat("base", "weak").alias("parts")).filter(F.exists("parts", _secret) & F.exists("parts", lambda x: ~_secret(x))).dropDuplicates(["key"])
    each = rows.select("key", F.explode("parts").alias("p"))
    met = _near(each.filter(~_secret(F.col("p"))), each.filter(_secret(F.col("p"))))
    return met.filter((F.col("q.start") >= F.col("p.end")) | (F.col("q.end") <= F.col("p.start")))


def link(scanned: DataFrame) -> DataFrame:
    """(key, linked, n_links, credentials) of the rows that have links: linked weak candidates, links, and the parts and endpoints of each credential."""
    extents = links(scanned).select("*", F.least("p.start", "q.start").alias("start"), F.greatest("p.end", "q.end").alias("end"))
    order = Window.partitionBy("key").orderBy("start", "end")
    fresh = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)) <= F.col("start"), F.lit(True))
    dealt = extents.withColumn("fresh", fresh.cast("int")).withColumn("c", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    extent = F.struct(F.min("start").alias("start"), F.max("end").alias("end"), F.col("c"))
    found = dealt.groupBy("key", "c").agg(extent.alias("p"), F.count(F.lit(1)).alias("n"), F.concat(F.collect_set("p"), F.collect_set("q")).alias("parts"))
    found = materialize(found, "secret-credentials")
    ends = scanned.filter("size(context) > 0").dropDuplicates(["key"]).select("key", F.explode("context").alias("p"))
    hosts = _near(found.select("key", "p"), ends).groupBy("key", F.col("p.c").alias("c")).agg(F.collect_set("q").alias("hosts"))
    each = found.join(hosts, ["key", "c"], "left").withColumn("whole", F.array_sort(F.concat("parts", F.coalesce("hosts", F.expr(NOTHING)))))
    rows = each.groupBy("key").agg(F.sum("n").alias("n_links"), F.array_sort(F.collect_list(F.struct("c", "whole"))).alias("all"), F.flatten(F.collect_list("parts")).alias("parts"))
    weak = F.array_sort(F.filter("parts", lambda x: x["kind"].isin("weak_access", "weak_secret")))
    return rows.select("key", weak.alias("linked"), "n_links", F.transform("all", lambda x: x["whole"]).alias("credentials"))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans, n_links, credentials): the strong spans and all reported ones, by start, then kind; links and what they make up."""
    scanned = materialize(scan(docs, id_col, text_col), "secret-scan")
    linked = materialize(link(scanned), "secret-links")
    spans = F.array_sort(F.concat("base", F.coalesce("linked", F.expr(NOTHING))))
    credentials = F.coalesce("credentials", F.expr(f"cast(array() as array<array<{SPAN}>>)"))
    return scanned.join(linked, "key", "left").select("id", "base", spans.alias("spans"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), credentials.alias("credentials"))


def listed(spans: Column, between: str = ",") -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), between)


def grouped(credentials: Column) -> Column:
    """The parts of each credential joined by +, credentials by commas."""
    return F.array_join(F.transform(credentials, lambda c: listed(c, "+")), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs, its columns as they are, with [REDACTED] in place of every reported span (overlapping ones as one)."""
    scanned = materialize(scan(docs, id_col, text_col).filter("size(base) > 0 or size(weak) > 0"), "secret-scan")
    linked = materialize(link(scanned).select("key", "linked"), "secret-links")
    spans = F.array_sort(F.concat("base", F.coalesce("linked", F.expr(NOTHING))))
    hits = scanned.dropDuplicates(["key"]).join(linked, "key", "left").select(F.col("key").alias("__key"), spans.alias("__spans")).filter("size(__spans) > 0")
    hits = materialize(hits, "secret-hits")
    keyed = docs.withColumn("__key", row_key(F.col(id_col), F.col(text_col))).join(hits, "__key", "left")
    text = F.col(text_col)
    start = F.struct(F.lit(0).alias("pos"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(text, acc["pos"] + 1, s["start"] - acc["pos"])
        fresh = s["start"] >= acc["pos"]
        return F.struct(F.greatest(acc["pos"], s["end"]).alias("pos"), F.when(fresh, F.concat(acc["out"], gap, F.lit("[REDACTED]"))).otherwise(acc["out"]).alias("out"))

    cut = F.aggregate("__spans", start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["pos"] + 1, F.length(text))))
    clean = F.when(F.col("__spans").isNotNull(), cut).otherwise(text)
    return keyed.withColumn(text_col, clean).select(*docs.columns)
