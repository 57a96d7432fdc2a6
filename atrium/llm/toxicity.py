"""Operator 8: toxicity by a weighted lexicon, matched with Aho-Corasick."""

from __future__ import annotations

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import row_key

TRAIN_ROWS = 20_000
LEXICON_SIZE = 5_000
PREFIX = range(4, 9)
LEAST_SIGHTINGS = 5
LEAST_PRECISION = 0.95
#: Chance that any entry of the lexicon is there by luck, all candidates that were tried taken together.
LUCK = 0.01
THRESHOLD = 0.7

# Characters that are read as another one. l and 1 fold to i.
LOOKALIKES = {
    "0": "o", "1": "i", "l": "i", "|": "i", "!": "i", "3": "e", "4": "a", "@": "a", "5": "s", "$": "s", "7": "t", "8": "b", "9": "g",
    "а": "a", "в": "b", "с": "c", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "á": "a", "à": "a", "â": "a", "ä": "a", "ã": "a", "å": "a", "é": "e", "è": "e", "ê": "e", "ë": "e", "í": "i", "ì": "i", "î": "i", "ï": "i", "ı": "i",
    "ó": "o", "ò": "o", "ô": "o", "ö": "o", "õ": "o", "ú": "u", "ù": "u", "û": "u", "ü": "u", "ç": "c", "ñ": "n",
}
#: Phrases in which a listed word is harmless; written as in a text.
EXCEPTIONS = ("trash can", "trash bin", "trash bag", "clown fish", "pond scum", "soap scum", "sore loser")


def folded(text: Column) -> Column:
    """Words of folded letters between single spaces, with a space at both ends."""
    wide = {chr(0xFF41 + i): chr(97 + i) for i in range(26)} | {chr(0xFF10 + i): str(i) for i in range(10)}
    wide = {k: LOOKALIKES.get(v, v) for k, v in wide.items()}
    table = {**wide, **LOOKALIKES}
    low = F.lower(F.coalesce(text, F.lit("")))
    # Marks that only end a word (as in "no!") are no letters.
    low = F.regexp_replace(low, r"[!|$@]+(?![\p{L}\p{N}])", " ")
    low = F.translate(low, "".join(table), "".join(table.values()))
    return F.concat(F.lit(" "), F.regexp_replace(low, r"[^\p{L}]+", " "), F.lit(" "))


def fold_phrase(phrase: str) -> str:
    return " " + " ".join("".join(LOOKALIKES.get(c, c) for c in w) for w in phrase.lower().split()) + " "


def training_sample(labels: DataFrame, label: str, rows: int = TRAIN_ROWS, id_col: str = "doc_id") -> DataFrame:
    """At most ``rows`` labelled ids, taken by a hash of the id: (id, y)."""
    return labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).select(id_col, F.col(label).cast("int").alias("y")).orderBy(F.xxhash64(F.lit(8), F.col(id_col)), "y").limit(rows)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = TRAIN_ROWS, size: int = LEXICON_SIZE, id_col: str = "doc_id", text_col: str = "text", exceptions: tuple[str, ...] = EXCEPTIONS) -> dict:
    """Learns the weighted lexicon from a bounded sample of labelled rows.

    For each folded word and word beginning of 4 to 8 letters the sample tells in
    how many different toxic and other texts it occurs; near copies count once,
    by the least hash of three words in a row. Entries are those seen at least 5 times in
    toxic texts with a precision of 0.95, if so many toxic ones would come by luck, at the
    toxic texts' share of the sample, with a chance below 0.01 divided by the number of all
    words and beginnings tried (a bound on the binomial tail). A beginning replaces the
    longer entries it covers. The weight is the smoothed log odds. Two numbers turn weight
    per word into a probability: a logistic fit on the sample's scores.

    The sample has at most ``rows`` rows (20,000) and the lexicon ``size`` entries
    (5,000). Without toxic rows the lexicon is empty and each score is 0.
    """
    sample = F.broadcast(training_sample(labels, label, rows, id_col))
    texts = docs.join(sample, id_col).select(id_col, "y", folded(F.col(text_col)).alias("t"))
    texts = texts.withColumn("all", F.split(F.trim("t"), " "))
    threes = F.transform(F.sequence(F.lit(1), F.greatest(F.size("all") - 2, F.lit(1))), lambda i: F.xxhash64(F.slice("all", i, 3)))
    texts = texts.select(id_col, "y", "t", F.array_distinct("all").alias("w"), F.array_min(threes).alias("sig"))
    once = texts.groupBy("y", "sig").agg(F.min_by("w", id_col).alias("w"))
    words = once.select("y", F.explode("w").alias("w")).groupBy("w").agg(F.sum("y").alias("bad"), F.sum(F.lit(1) - F.col("y")).alias("good"))
    starts = F.array(F.concat(F.lit(" "), "w", F.lit(" ")), *[F.when(F.char_length("w") > n, F.concat(F.lit(" "), F.substring("w", 1, n))) for n in PREFIX])
    terms = words.where(F.char_length("w") > 1).select(F.explode(F.array_compact(starts)).alias("term"), "bad", "good").groupBy("term").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    share = once.agg(F.avg("y")).first()[0] or 0.0
    tried = terms.count()
    terms = terms.where((F.col("bad") >= LEAST_SIGHTINGS) & (F.col("bad") >= LEAST_PRECISION * (F.col("bad") + F.col("good"))))
    found = [(r["term"], r["bad"], r["good"]) for r in terms.orderBy(F.col("bad").desc(), "term").limit(size).collect()]
    found = [x for x in found if luck(x[1], x[1] + x[2], share) * tried < LUCK]
    lexicon: dict[str, float] = {}
    for term, bad, good in sorted(found, key=lambda x: (len(x[0].rstrip()), x[0])):
        if not any(term[:n] in lexicon for n in range(1, len(term))):
            lexicon[term] = float(np.log((bad + 1) / (good + 1)) + 1)
    model = {"lexicon": lexicon, "exceptions": [fold_phrase(x) for x in exceptions], "slope": 4.0, "middle": 1.0}
    if lexicon:
        seen = weigh(texts.select(id_col, "t", "y"), model, id_col, "t", ["y"]).select("rate", "y").toPandas()
        model |= logistic(seen["rate"].to_numpy(), seen["y"].to_numpy(float))
    return model


def luck(hits: int, n: int, share: float) -> float:
    """An upper bound of the chance of at least so many hits in n tries at this share (Chernoff)."""
    if hits <= n * share or not n:
        return 1.0
    if share <= 0:
        return 0.0
    rate = hits / n
    apart = rate * np.log(rate / share) + ((1 - rate) * np.log((1 - rate) / (1 - share)) if rate < 1 else 0.0)
    return float(np.exp(-n * apart))


def logistic(x: np.ndarray, y: np.ndarray, steps: int = 400) -> dict:
    """slope and middle of p = 1/(1+exp(-slope*(x-middle))), with the two classes weighted alike."""
    if len(x) == 0 or y.min() == y.max():
        return {}
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)
    a, b = 4.0, -2.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = weight * (p - y)
        h = weight * p * (1 - p)
        grad = np.array([(g * x).sum() + 1e-4 * a, g.sum()])
        hess = np.array([[(h * x * x).sum() + 1e-4, (h * x).sum()], [(h * x).sum(), h.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(hess, grad), -1, 1)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-7:
            break
    return {"slope": float(a), "middle": float(-b / a)} if a > 0 else {}


def _matcher(model: dict):
    automaton = ahocorasick.Automaton()
    for term, w in model["lexicon"].items():
        automaton.add_word(term, (w, len(term)))
    for phrase in model["exceptions"]:
        automaton.add_word(phrase, (0.0, len(phrase)))
    if len(automaton):
        automaton.make_automaton()
    return automaton


def weigh(rows: DataFrame, model: dict, id_col: str, folded_col: str, carry: list[str] | None = None) -> DataFrame:
    """(id, carried, hits, weight, rate): what the lexicon finds in folded texts.

    A hit inside an exception phrase does not count. rate = ln(1 + 100 * weight / (words + 20)).
    """
    carry = carry or []
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        automaton = _matcher(shared.value)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(folded_col))
            hits, weights, rates = [], [], []
            for text in texts:
                text = text.as_py() or ""
                found = list(automaton.iter(text)) if len(automaton) else []
                spared = [(end - size + 1, end) for end, (w, size) in found if w == 0]
                ends: dict[int, float] = {}
                for end, (w, size) in found:
                    first = end - size + 1
                    if w and not any(a <= first and first < b for a, b in spared):
                        ends[first] = max(w, ends.get(first, 0.0))
                total = sum(ends.values())
                hits.append(len(ends))
                weights.append(total)
                rates.append(float(np.log1p(100 * total / (max(0, text.count(" ") - 1) + 20))))
            kept = [batch.column(batch.schema.get_field_index(c)) for c in [id_col, *carry]]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(hits, pa.int32()), pa.array(weights, pa.float64()), pa.array(rates, pa.float64())], [id_col, *carry, "hits", "weight", "rate"])

    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = ", ".join(f"`{c}` {types[c]}" for c in [id_col, *carry]) + ", hits int, weight double, rate double"
    return rows.select(id_col, *carry, folded_col).mapInArrow(run, schema)


def score_toxicity(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, hits, weight): the toxicity of each whole text, between 0 and 1.

    Letters are folded first (case, accents, homoglyphs of other scripts, digits
    and signs used as letters), then one Aho-Corasick pass finds all entries at
    word starts. Their weight is set against the text's number of words.

    Null and empty texts have no hits and so the lowest score. Every row gives
    one row; repeated or null ids stay as they are. Other columns are ignored.
    """
    rows = docs.select(F.col(id_col), folded(F.col(text_col)).alias("__folded"))
    seen = weigh(rows, model, id_col, "__folded")
    score = F.when(F.col("hits") > 0, 1 / (1 + F.exp(-F.lit(float(model["slope"])) * (F.col("rate") - float(model["middle"]))))).otherwise(F.lit(0.0))
    return seen.select(id_col, score.alias("score"), "hits", "weight")


def reject_toxic(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score is below the threshold, in their own columns; each row is judged by its own text."""
    rows = docs.select(row_key(id_col, text_col).alias("__key"), F.col(text_col).alias("__text"))
    toxic = score_toxicity(rows, model, "__key", "__text").where(F.col("score") >= threshold).select("__key").distinct()
    return docs.withColumn("__key", row_key(id_col, text_col)).join(toxic, "__key", "left_anti").select(*docs.columns)
