"""Operator 5: benchmark decontamination by template canonicalisation (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keep_slots, materialize, row_key

WINDOW = 8
LEAST_COVER = 0.5
#: Windows in a row that are enough whatever the item's length: 15 words. Where values conflict elsewhere in the alignment, changed ones need 22.
RUN, CONFLICT_RUN = 8, 15
#: Plain words that a window needs to count in a run with changed values, and a short item to be found with other values.
LEAST_PLAIN = 4

NAME, NUMBER, UNIT = "\u0001", "\u0002", "\u0003"
# Words that stand for a unit or a number.
UNITS = ["mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "mile", "miles", "g", "kg", "lb", "lbs", "pound", "pounds", "ton", "tons", "ml", "l", "liter", "liters", "litre", "litres", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "usd", "eur", "dollar", "dollars", "euro", "euros", "cent", "cents", "percent", "degree", "degrees"]
NUMBERS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "twenty", "thirty", "forty", "fifty", "hundred", "thousand", "million"]


def words(text: Column, named: bool = True) -> Column:
    """Words in lower case without punctuation; a name (capitalised inside a sentence) starts with a mark, unless ``named`` is false."""
    text = F.translate(F.coalesce(text, F.lit("")), NAME + NUMBER + UNIT, "")
    if named:
        text = F.regexp_replace(text, r"(?<=[\p{L}\p{N},;:)]\s)(?=\p{Lu}\p{Ll})", NAME)
    # Upper case has no sharp s and no final sigma.
    low = F.translate(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), "ς", "σ")
    bare = F.regexp_replace(low, rf"[^\p{{L}}\p{{N}}\s{NAME}]+", "")
    return F.filter(F.split(bare, r"[\s]+"), lambda w: w != "")


def template(word: Column) -> Column:
    """The word in lower case, or the typed placeholder that stands for it."""
    return F.when(word.startswith(NAME), NAME).when(((word >= "0") & (word < ":")) | word.isin(NUMBERS), NUMBER).when(word.isin(UNITS), UNIT).otherwise(word)


def shifted(df: DataFrame, id_col: str, text_col: str, size: int, least: int, named: bool) -> DataFrame:
    """(id, at, n, u0.., w0.., t0..): templates' hashes and words from each place on; null behind the text's end. Texts with fewer than ``least`` words give nothing.

    u takes names as plain words, as they are in a text in another case; t, only if ``named``, as names.
    """
    rows = df.select(F.col(id_col).alias("id"), words(F.col(text_col), named).alias("w")).where(F.size("w") >= least)
    if named:
        rows = rows.withColumn("t", F.transform("w", lambda w: F.xxhash64(template(w)))).withColumn("w", F.transform("w", lambda w: F.translate(w, NAME, "")))
    rows = rows.withColumn("u", F.transform("w", lambda w: F.xxhash64(template(w))))
    n = F.size("w")
    moved = [F.slice(c, k + 1, n).alias(f"{c}{k}") for k in range(size) for c in ("u", "w", "t")[: 2 + named]]
    return rows.select("id", n.alias("n"), F.inline(F.arrays_zip(F.sequence(F.lit(0), n - 1).alias("at"), *moved)))


def _hash(kind: str, size: int) -> Column:
    return F.xxhash64(F.lit(size), *[F.col(f"{kind}{k}") for k in range(size)])


def _literal(size: int) -> Column:
    return F.xxhash64(F.lit(-size), *[F.col(f"w{k}") for k in range(size)])


def item_windows(benchmark: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """(item, q, size, key, named, item_slots): each window of an item, or the whole item if it is shorter; '' where no placeholder stands.

    A window with names has two keys: with the names' placeholders (``named``), and with the names as words.
    """
    rows = shifted(benchmark.where(F.col(item_col).isNotNull()), item_col, text_col, window, 1, True).withColumn("size", F.least("n", F.lit(window))).where(F.col("at") + F.col("size") <= F.col("n"))
    placeholders = [F.xxhash64(F.lit(x)) for x in (NAME, NUMBER, UNIT)]
    slots = F.array(*[F.when(F.col(f"t{k}").isin(*placeholders), F.col(f"w{k}")).otherwise("") for k in range(window)])
    rows = rows.withColumn("item_slots", F.slice(slots, 1, F.col("size")))
    # A short item of few plain words says too little: it is looked for in its own words.
    strict = (F.col("size") < window) & (F.size(F.filter("item_slots", lambda x: x == "")) < LEAST_PLAIN)
    key = lambda kind: F.coalesce(*[F.when(F.col("size") == k, F.when(strict, _literal(k)).otherwise(_hash(kind, k))) for k in range(1, window + 1)])
    both = F.array(F.struct(key("u").alias("key"), F.lit(False).alias("named")), F.when(key("t") != key("u"), F.struct(key("t").alias("key"), F.lit(True).alias("named"))))
    return rows.select(F.col("id").alias("item"), F.col("at").alias("q"), "size", F.inline(F.array_compact(both)), "item_slots")


def windows(docs: DataFrame, id_col: str, text_col: str, window: int, short: list[int], named: bool) -> DataFrame:
    """(id, at, key, slots): each window of template words with its words, and the windows of the short items' lengths; with two keys where it has names and ``named`` is true."""
    kinds = ("u", "t")[: 1 + named]
    rows = shifted(docs, id_col, text_col, window, window, named).where(F.col(f"u{window - 1}").isNotNull())
    key = F.explode(F.array_distinct(F.array(*[_hash(c, window) for c in kinds]))) if named else _hash("u", window)
    out = rows.select("id", "at", key.alias("key"), F.array(*[F.col(f"w{k}") for k in range(window)]).alias("slots"))
    if short:
        rows = shifted(docs, id_col, text_col, max(short), min(short), named)
        keys = F.array(*[F.when(F.col(f"u{k - 1}").isNotNull(), x) for k in short for x in (*[_hash(c, k) for c in kinds], _literal(k))])
        out = out.unionByName(rows.select("id", "at", F.explode(F.array_distinct(F.array_compact(keys))).alias("key"), F.array(*[F.col(f"w{k}") for k in range(max(short))]).alias("slots")))
    return out


def _one_to_one(pairs: Column) -> Column:
    one = lambda k: F.size(F.array_distinct(F.transform(pairs, lambda p: p[k]))) == F.size(pairs)
    return one("i") & one("d")


def _starts(q: Column, run: int) -> Column:
    """Places (from 0) in the ascending numbers ``q`` at which ``run`` consecutive ones begin."""
    return F.filter(F.transform(q, lambda x, i: F.when(F.get(q, i + F.lit(run - 1)) - x == run - 1, i)), lambda i: i.isNotNull())


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, least_cover: float = LEAST_COVER) -> DataFrame:
    """Pairs (id, item, cover, verbatim) of documents and the benchmark items found in them.

    Numbers, names and units become typed placeholders, so a question asked with
    other values has the same template. What is a name is told by its capital; in a
    copy in another case the item's names are looked for as plain words. Windows of ``window`` template words of
    documents and items are hash-joined. Windows that match along one alignment
    are checked together: each value of the item's slots must stand for one value
    in the document, and each document value for one of the item. If that fails
    for the alignment, its windows with the item's own values count all the same,
    and so do 15 in a row that agree among themselves. ``cover`` is the share of
    the item's windows that count; a pair needs ``least_cover``, or 8 counting
    windows in a row (15 words) whatever the item's length. In such a run a window
    has the item's own values or at least 4 plain words. ``verbatim`` tells that
    all slot values are the item's.

    An item with fewer than ``window`` words is one window as long as itself; with
    fewer than 4 plain words it is found only in its own words. Whole texts are
    read. Null and empty texts and items match nothing. Rows count as one document
    if id and text are equal; null ids are ids like others, null item ids are left
    out. Documents' windows are reduced by a bounded broadcast of the
    items' slots, then joined with the items by shuffle.
    """
    found = pairs_of(docs, id_col, text_col, benchmark, item_col, item_text, window, least_cover)
    ids = docs.select(row_key(id_col, text_col).alias("__key"), F.col(id_col)).join(found, "__key").dropDuplicates(["__key", "item"])
    return ids.select(id_col, "item", "cover", "verbatim")


def pairs_of(docs: DataFrame, id_col: str, text_col: str, benchmark: DataFrame, item_col: str, item_text: str, window: int, least_cover: float) -> DataFrame:
    """(__key, item, cover, verbatim): what ``contaminated`` finds, by the row's key."""
    items = materialize(item_windows(benchmark, item_col, item_text, window), "items")
    total = items.groupBy("item").agg(F.countDistinct("q").alias("n"))
    short = sorted(r["size"] for r in items.where(F.col("size") < window).select("size").distinct().collect())
    named = not items.where("named").isEmpty()
    rows = windows(docs.select(row_key(id_col, text_col).alias("__key"), F.col(text_col).alias("__text")), "__key", "__text", window, short, named)
    hits = keep_slots(rows, items, ["key"]).join(items, "key")
    pairs = F.array_distinct(F.filter(F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d")), lambda s: s["i"] != ""))
    plain = F.size(F.filter("item_slots", lambda x: x == ""))
    hits = hits.select("id", "item", (F.col("at") - F.col("q")).alias("shift"), F.struct("q", pairs.alias("pairs"), plain.alias("plain")).alias("w"))
    aligned = hits.groupBy("id", "item", "shift").agg(F.array_sort(F.collect_set("w")).alias("w"))
    same = lambda pairs: F.forall(pairs, lambda p: p["i"] == p["d"])
    every = F.array_distinct(F.flatten("w.pairs"))
    aligned = aligned.withColumn("own", F.filter("w", lambda x: same(x["pairs"]))).withColumn("ok", _one_to_one(every)).withColumn("verbatim", same(every))
    agree = F.filter(_starts(F.col("w.q"), CONFLICT_RUN), lambda i: _one_to_one(F.array_distinct(F.flatten(F.transform(F.slice("w", i + 1, CONFLICT_RUN), lambda x: x["pairs"])))))
    agree = F.array_distinct(F.flatten(F.transform(agree, lambda i: F.slice("w", i + 1, CONFLICT_RUN))))
    aligned = aligned.withColumn("counts", F.when(F.col("ok"), F.col("w")).otherwise(F.array_sort(F.array_union("own", agree))))
    firm = F.filter("counts", lambda x: same(x["pairs"]) | (x["plain"] >= LEAST_PLAIN))
    aligned = aligned.withColumn("firm", F.transform(firm, lambda x: x["q"])).withColumn("run", F.size(_starts(F.col("firm"), RUN)) > 0)
    # Where the alignment conflicts, a run with changed values has to be as long as an agreeing part.
    own = F.size(_starts(F.col("own.q"), RUN)) > 0
    long = F.size(_starts(F.col("firm"), CONFLICT_RUN)) > 0
    aligned = aligned.withColumn("run", F.when(F.col("ok"), F.col("run")).otherwise(own | long))
    found = aligned.select("id", "item", "verbatim", "run", F.explode("counts.q").alias("q")).groupBy("id", "item", "q").agg(F.max("verbatim").alias("verbatim"), F.max("run").alias("run"))
    found = found.groupBy("id", "item").agg(F.count(F.lit(1)).alias("m"), F.min("verbatim").alias("verbatim"), F.max("run").alias("run"))
    out = found.join(total, "item").withColumn("cover", F.col("m") / F.col("n"))
    return out.where((F.col("cover") >= least_cover) | F.col("run")).select(F.col("id").alias("__key"), "item", "cover", "verbatim")


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, least_cover: float = LEAST_COVER) -> DataFrame:
    """One row per document: (id, contaminated, items, best_cover, reworded)."""
    found = pairs_of(docs, id_col, text_col, benchmark, item_col, item_text, window, least_cover)
    found = found.groupBy("__key").agg(F.array_sort(F.collect_set("item")).alias("items"), F.round(F.max("cover"), 6).alias("best_cover"), F.max(~F.col("verbatim")).alias("reworded"))
    out = docs.select(id_col, row_key(id_col, text_col).alias("__key")).join(found, "__key", "left")
    return out.select(id_col, F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.expr("cast(array() as array<bigint>)")).alias("items"), F.coalesce("best_cover", F.lit(0.0)).alias("best_cover"), F.coalesce("reworded", F.lit(False)).alias("reworded"))


def clean_of(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, least_cover: float = LEAST_COVER) -> DataFrame:
    """The documents in which no benchmark item is found."""
    found = pairs_of(docs, id_col, text_col, benchmark, item_col, item_text, window, least_cover).select("__key").distinct()
    return docs.withColumn("__key", row_key(id_col, text_col)).join(found, "__key", "left_anti").select(*docs.columns)
