"""Operator 10: secret scans by pattern and sliding-window entropy (native)."""

from __future__ import annotations

import math
import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The contract's patterns.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex")

# Candidates for the entropy scan: long runs of key-like characters.
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
WINDOW = 20
#: Bits per character that a window must reach, by the class of its string. A window of 20 digits has at most 3.3: that class is off.
LEAST_BITS = {"digits": 9.0, "hex": 3.0, "alnum": 3.6, "base64": 3.6}
#: Strings that look random and are public: UUIDs, documentation keys, digest prefixes, data addresses.
ALLOWED = r"(?i)^([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|.*example.*|sha(1|256|384|512)-.*|[0-9/_=-]+)$"

_MARK = "\u0001"
#: Parts of a text that are gathered at a time; even, so that each block begins with a part that is no match.
BLOCK = 512


def _none() -> Column:
    return F.expr("cast(array() as array<struct<start:int,end:int,order:int,kind:string,match:string>>)")


def _let(value: Column, then) -> Column:
    """``then`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _parts(text: Column, pattern: str) -> Column:
    """The text cut at the matches: odd elements (from 0) are matches."""
    return F.split(F.regexp_replace(text, pattern, f"{_MARK}$0{_MARK}"), _MARK, -1)


def _spans(parts: Column, kind: str, keep) -> Column:
    """array<struct<start,end,order,kind,match>> of the matches that pass ``keep``, with code point offsets.

    Parts are taken in blocks of BLOCK, so lists that grow by an element at a time stay short.
    """
    order = KINDS.index(kind) if kind in KINDS else len(KINDS)
    length = lambda ps: F.aggregate(ps, F.lit(0), lambda n, p: n + F.char_length(p))

    def spans(block: Column, start: Column) -> Column:
        begin = F.struct(start.alias("at"), F.lit(0).alias("i"), _none().alias("out"))

        def step(acc: Column, part: Column) -> Column:
            end = (acc["at"] + F.char_length(part)).cast("int")
            span = F.struct(acc["at"].alias("start"), end.alias("end"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), part.alias("match"))
            out = F.when((acc["i"] % 2 == 1) & keep(part), F.concat(acc["out"], F.array(span))).otherwise(acc["out"])
            return F.struct(end.alias("at"), (acc["i"] + 1).alias("i"), out.alias("out"))

        return F.aggregate(block, begin, step, lambda acc: acc["out"])

    def of(parts: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.size(parts) - 1, F.lit(BLOCK)), lambda i: F.slice(parts, i + 1, BLOCK))
        return _let(blocks, lambda bs: _let(_starts(F.transform(bs, length)), lambda at: F.flatten(F.transform(bs, lambda b, i: spans(b, F.get(at, i))))))

    return _let(parts, of)


def _starts(lengths: Column) -> Column:
    """Where each block begins."""
    return F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array((F.element_at(acc, -1) + n).cast("int"))))


def _class(s: Column) -> Column:
    return F.when(s.rlike("^[0-9]+$"), "digits").when(s.rlike("^[0-9a-fA-F]+$"), "hex").when(s.rlike("^[0-9a-zA-Z]+$"), "alnum").otherwise("base64")


def _least(s: Column) -> Column:
    return reduce(lambda out, k: out.when(_class(s) == k, LEAST_BITS[k]), LEAST_BITS, F.when(F.lit(False), 0.0))


def _cut(c: Column, base: Column, window: int) -> Column:
    """What the base spans (in order) leave of a candidate, as spans of at least ``window`` characters."""
    start = F.struct(c["start"].alias("at"), _none().alias("out"))

    def add(acc: Column, end: Column) -> Column:
        piece = F.struct(acc["at"].alias("start"), end.alias("end"), c["order"].alias("order"), c["kind"].alias("kind"), F.substring(c["match"], acc["at"] - c["start"] + 1, end - acc["at"]).alias("match"))
        return F.when(end - acc["at"] >= window, F.concat(acc["out"], F.array(piece))).otherwise(acc["out"])

    def step(acc: Column, b: Column) -> Column:
        meets = (b["start"] < c["end"]) & (c["start"] < b["end"])
        return F.struct(F.when(meets, F.greatest(acc["at"], b["end"])).otherwise(acc["at"]).alias("at"), F.when(meets, add(acc, b["start"])).otherwise(acc["out"]).alias("out"))

    return F.aggregate(base, start, step, lambda acc: add(acc, c["end"]))


def _begun(spans: Column, points: Column) -> Column:
    """For each of the points, which ascend, how many of the spans begin before it: both in one sorted array."""
    ends = F.concat(F.transform(points, lambda p: F.struct(p.alias("at"), F.lit(0).alias("span"))), F.transform(spans, lambda s: F.struct(s["start"].alias("at"), F.lit(1).alias("span"))))
    numbered = F.transform(F.array_sort(ends), lambda x, i: F.struct(x["span"].alias("span"), i.alias("i")))
    return F.transform(F.filter(numbered, lambda x: x["span"] == 0), lambda x, j: x["i"] - j)


def _left_over(candidates: Column, bases: list[Column], window: int) -> Column:
    """What the base spans leave of all candidates.

    Spans of one kind do not overlap, so of each kind only those meet a candidate that begin within it, and the last
    one before. They are found by their numbers: the work grows with spans and candidates, not with their product.
    """

    def of(lists: Column) -> Column:
        def meeting(c: Column, j: Column) -> Column:
            own = []
            for k in range(len(bases)):
                low, high = F.greatest(F.get(lists[f"low{k}"], j) - 1, F.lit(0)), F.get(lists[f"high{k}"], j)
                own.append(F.slice(lists[f"base{k}"], low + 1, high - low))
            return _cut(c, F.array_sort(F.concat(*own)), window)

        return F.flatten(F.transform(lists["candidates"], meeting))

    starts, ends = F.transform(candidates, lambda c: c["start"]), F.transform(candidates, lambda c: c["end"])
    parts = [candidates.alias("candidates")]
    for k, b in enumerate(bases):
        parts += [b.alias(f"base{k}"), _begun(b, starts).alias(f"low{k}"), _begun(b, ends).alias(f"high{k}")]
    return _let(F.struct(*parts), of)


def _hot_windows(codes: Column, least: Column, window: int) -> Column:
    """(first, last) character of the windows that reach the entropy, or -1.

    One pass: the counts of the window's characters change by one that comes and
    one that goes, and with them the sum of c*log2(c); the entropy of w characters is
    log2(w) - sum/w.
    """
    terms = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(window + 2)])
    start = F.struct(F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("counts"), F.lit(0.0).alias("total"), F.lit(0).alias("i"), F.lit(-1).alias("first"), F.lit(-1).alias("last"))

    def step(acc: Column, code: Column) -> Column:
        gone = F.when(acc["i"] >= window, F.get(codes, acc["i"] - window)).otherwise(-1)
        n, m = F.get(acc["counts"], code), F.get(acc["counts"], F.greatest(gone, F.lit(0))) + F.when(gone == code, 1).otherwise(0)
        total = acc["total"] + F.get(terms, n + 1) - F.get(terms, n) + F.when(gone >= 0, F.get(terms, m - 1) - F.get(terms, m)).otherwise(0.0)
        counts = F.transform(acc["counts"], lambda c, j: c + F.when(j == code, 1).otherwise(0) - F.when(j == gone, 1).otherwise(0))
        hot = (acc["i"] >= window - 1) & (math.log2(window) - total / window >= least)
        first = F.when(hot & (acc["first"] < 0), acc["i"] - (window - 1)).otherwise(acc["first"])
        last = F.when(hot, acc["i"]).otherwise(acc["last"])
        return F.struct(counts.alias("counts"), total.alias("total"), (acc["i"] + 1).alias("i"), first.alias("first"), last.alias("last"))

    return F.aggregate(codes, start, step, lambda acc: F.struct(acc["first"].alias("first"), acc["last"].alias("last")))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Finds secrets: (id, spans array<struct<start,end,order,kind,match>>).

    Kinds assign, access and hex are the patterns' leftmost non-overlapping
    matches that are long enough. Kind entropy covers, in other long key-like
    strings, the part from the first to the last window of ``window`` characters
    whose Shannon entropy reaches the bits set for the string's character class,
    unless the string is on the allow-list. Spans of the other kinds are cut out
    of the strings first; each part that is left is judged as a string of its own.
    Strings of digits alone are never reported.
    Offsets count code points, the end is exclusive; spans are ordered by start,
    then kind.

    Null text counts as empty; a text without matches has an empty list. Every
    input row gives one row, with ids as they are (null or repeated too). Texts
    with the character U+0001 are scanned as if it were U+0002; no pattern holds
    either. Other columns are ignored.
    """
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), _MARK, "\u0002")
    value = lambda m: F.char_length(F.regexp_extract(m, ASSIGN, 2)) >= 6
    rows = docs.select(F.col(id_col).alias(id_col), text.alias("__t"))
    rules = {"assign": (ASSIGN, value), "access": (r"AKIA[A-Z0-9]{16,}", lambda m: F.lit(True)), "hex": (r"[0-9a-f]{24,}", lambda m: F.lit(True)), "entropy": (CANDIDATE, lambda m: ~m.rlike(ALLOWED))}
    for kind, (pattern, keep) in rules.items():
        rows = rows.withColumn(f"__{kind}", F.when(F.col("__t").rlike(pattern), _spans(_parts(F.col("__t"), pattern), kind, keep)).otherwise(_none()))
    base = F.concat(*[F.col(f"__{k}") for k in KINDS])
    rows = rows.drop("__t").withColumn("__base", F.array_sort(base))
    left = F.filter(_left_over(F.col("__entropy"), [F.col(f"__{k}") for k in KINDS], window), lambda c: ~c["match"].rlike(ALLOWED))
    rows = rows.withColumn("__entropy", F.when((F.size("__entropy") > 0) & (F.size("__base") > 0), left).otherwise(F.col("__entropy")))
    once = F.transform("__entropy", lambda c: F.struct(c.alias("c"), F.transform(F.split(c["match"], ""), lambda x: F.instr(F.lit(ALPHABET), x)).alias("codes"), _least(c["match"]).alias("least")))
    hot = F.transform(once, lambda x: F.struct(x["c"].alias("c"), _hot_windows(x["codes"], x["least"], window).alias("w")))
    hot = F.filter(hot, lambda x: x["w"]["first"] >= 0)
    at = lambda x, k: (x["c"]["start"] + x["w"][k]).cast("int")
    found = F.transform(hot, lambda x: F.struct(at(x, "first").alias("start"), (at(x, "last") + 1).cast("int").alias("end"), x["c"]["order"].alias("order"), x["c"]["kind"].alias("kind"), F.substring(x["c"]["match"], x["w"]["first"] + 1, x["w"]["last"] - x["w"]["first"] + 1).alias("match")))
    added = F.when(F.size("__entropy") > 0, found).otherwise(_none())
    return rows.select(id_col, F.array_sort(F.concat("__base", added)).alias("spans"))


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digests of the spans."""
    name = lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.array_join(F.transform(F.filter("spans", lambda x: x["kind"] != "entropy"), name), ",")
    return scanned.select(id_col, *[count(k) for k in KINDS], F.sha2(base, 256).alias("base_sha256"), F.array_join(F.transform("spans", name), ",").alias("spans"))
