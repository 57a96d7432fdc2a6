"""Operator 7: language of pages by Bayesian evidence fusion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import materialize, salted_left_join
from .url_filter import split_url

BUCKETS = 1 << 15
TRAIN_PER_LANGUAGE = 1_500
MOST_LANGUAGES = 64
#: A text counts as at most this many independent 3-grams.
EVIDENCE = 60
RELIABLE = {"declared": 0.9, "suffix": 0.7}
STRENGTH = 20.0
# Country domains whose main language has another code.
COUNTRIES = {"at": "de", "uk": "en", "us": "en", "au": "en", "mx": "es", "ar": "es", "be": "fr"}


def visible(html: Column) -> Column:
    """The text of a page: scripts, styles, comments and tags out, entities as spaces."""
    bare = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", " ")
    return F.regexp_replace(F.regexp_replace(bare, r"<[^>]*>", " "), r"&[#\w]+;", " ")


def _trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed 3-grams of bytes and their documents; ASCII letters lower-cased, other ASCII a space."""
    data = kernel.fold_ascii(data)
    data = np.where((data >= 128) | ((data >= 97) & (data <= 122)), data, 32).astype(np.uint64)
    if len(data) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h = kernel.mix((data[:-2] * np.uint64(65536) + data[1:-1] * np.uint64(256) + data[2:]) + np.uint64(1))
    doc = np.searchsorted(offsets, np.arange(len(data)), side="right") - 1
    good = (doc[:-2] == doc[2:]) & ~((data[:-2] == 32) & (data[1:-1] == 32))
    return (h % np.uint64(BUCKETS)).astype(np.int64)[good], doc[:-2][good]


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", per_language: int = TRAIN_PER_LANGUAGE) -> dict:
    """Log probabilities of 3-grams per language, from at most ``per_language`` texts each, chosen by a hash of the id.

    The languages are those of the labelled texts; more than 64 is an error.
    """
    known = docs.where(F.col(lang_col).isNotNull())
    sizes = known.groupBy(lang_col).count().limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(r[0] for r in sizes)
    if not languages:
        return {"languages": ["und"], "table": np.zeros((BUCKETS, 1), np.float32)}
    # Texts are taken by a hash of the id below a bound that gives about per_language of each.
    bound = {r[0]: min(1.0, per_language / r[1]) for r in sizes}
    rate = F.create_map(*[F.lit(x) for l in languages for x in (l, bound[l])])
    chosen = known.where(F.pmod(F.xxhash64(F.lit(7), F.col(id_col)), F.lit(1_000_000)) < F.element_at(rate, F.col(lang_col)) * 1_000_000)

    def run(batches):
        counts = np.zeros((len(languages), BUCKETS), np.int64)
        for batch in batches:
            lang = np.searchsorted(languages, batch.column(0).to_pylist())
            data, offsets = kernel.buffers(batch.column(1))
            for a, b in kernel.chunks(offsets):
                gram, doc = _trigrams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                counts += np.bincount(lang[a + doc] * BUCKETS + gram, minlength=counts.size).reshape(counts.shape)
        l, g = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(l.astype(np.int32)), pa.array(g.astype(np.int32)), pa.array(counts[l, g])], ["l", "g", "n"])

    got = chosen.select(lang_col, text_col).mapInArrow(run, "l int, g int, n long").groupBy("l", "g").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((BUCKETS, len(languages)), 0.5)
    table[got["g"].to_numpy(), got["l"].to_numpy()] += got["n"].to_numpy()
    return {"languages": languages, "table": np.log(table / table.sum(axis=0)).astype(np.float32)}


def text_evidence(rows: DataFrame, model: dict, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """Adds ``ll``: for each language the log likelihood of the text, as of at most EVIDENCE 3-grams."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    width = len(model["languages"])

    def run(batches):
        table = shared.value["table"]
        for batch in batches:
            data, offsets = kernel.buffers(batch.column(batch.num_columns - 1))
            out = np.zeros((batch.num_rows, width))
            for a, b in kernel.chunks(offsets):
                gram, doc = _trigrams(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                count = np.bincount(doc, minlength=b - a)
                for l in range(width):
                    out[a:b, l] = np.bincount(doc, weights=table[gram, l], minlength=b - a) / np.maximum(count, 1)
                out[a:b] *= np.minimum(count, EVIDENCE)[:, None]
            out -= out.max(axis=1, keepdims=True) if batch.num_rows else 0
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, width, dtype=np.int32)), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(batch.num_columns - 1)], lists], [id_col, *carry, "ll"])

    kinds = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in [id_col, *carry]) + ", ll array<double>"
    return rows.select(id_col, *carry, text_col).mapInArrow(run, schema)


def identify(pages: DataFrame, model: dict, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, lang, confidence, host, declared, suffix, text_lang) for every page.

    Four pieces of evidence are multiplied: the likelihood of the visible text,
    the language that the markup declares (lang of <html>), the one of the
    address (country domain, or else a first path part like /de/), and the prior
    of the host. A declaration is right with probability 0.9, an address with
    0.7; the rest is spread over the other languages.

    Host priors come from grouped sums of the pages' own text posteriors, smoothed
    at each level by the one above: host, registered domain (last two labels),
    all pages, uniform. A page's own posterior is left out of its host's sums.

    Null urls, null or empty pages give no evidence of that kind; a page without
    any has the prior's best language. Ties go to the first language by name.
    Rows with repeated or null ids stay as they are. Other columns are ignored.
    """
    languages = model["languages"]
    host, path = split_url(url_col)
    low = F.lower(F.coalesce(F.col(html_col), F.lit("")))
    rows = pages.select(
        F.col(id_col),
        host.alias("host"),
        F.regexp_extract(low, r"""<html\b[^>]*?\blang\s*=\s*["']?([a-z]{2,3})""", 1).alias("declared"),
        F.regexp_extract(host, r"\.([a-z]{2})$", 1).alias("country"),
        F.regexp_extract(F.lower(path), r"^/([a-z]{2})(?:/|$)", 1).alias("part"),
        visible(F.col(html_col)).alias("text"),
    )
    country = F.coalesce(*[F.when(F.col("country") == k, v) for k, v in COUNTRIES.items()], F.col("country"))
    known = lambda c: F.when(c.isin(languages), c)
    rows = rows.withColumn("suffix", F.coalesce(known(country), known(F.col("part")))).withColumn("declared", known(F.col("declared")))
    rows = text_evidence(rows, model, id_col, "text", ["host", "declared", "suffix"])
    weight = F.transform("ll", F.exp)
    rows = rows.withColumn("p", F.transform(weight, lambda x: x / F.aggregate(weight, F.lit(0.0), lambda a, y: a + y)))
    rows = rows.withColumn("domain", F.regexp_extract("host", r"([^.]+\.[^.]+)$", 1)).withColumn("domain", F.when(F.col("domain") == "", F.col("host")).otherwise(F.col("domain")))
    rows = materialize(rows, "evidence")

    n = len(languages)
    sums = lambda df, prefix: [F.sum(df[f"c{i}"]).alias(f"{prefix}{i}") for i in range(n)]
    by_host = materialize(rows.groupBy("host", "domain").agg(*[F.sum(F.col("p")[i]).alias(f"c{i}") for i in range(n)]), "hosts")
    by_domain = by_host.groupBy("domain").agg(*sums(by_host, "d"))
    overall = by_host.agg(*sums(by_host, "g")).first()
    total = sum(overall[f"g{i}"] or 0.0 for i in range(n))
    top = [((overall[f"g{i}"] or 0.0) + STRENGTH / n) / (total + STRENGTH) for i in range(n)]
    level = lambda c, above: [(F.col(f"{c}{i}") + STRENGTH * above[i]) / (sum(F.col(f"{c}{k}") for k in range(n)) + STRENGTH) for i in range(n)]
    by_domain = by_domain.select("domain", *[x.alias(f"q{i}") for i, x in enumerate(level("d", [F.lit(x) for x in top]))])
    priors = by_host.join(by_domain, "domain").select(F.col("host"), F.array(*[F.col(f"c{i}") for i in range(n)]).alias("seen"), F.array(*[F.col(f"q{i}") for i in range(n)]).alias("above"))
    out = salted_left_join(rows, priors, ["host"], F.xxhash64(id_col))
    others = max(1, n - 1)
    terms = []
    for i, name in enumerate(languages):
        left = F.greatest(F.col("seen")[i] - F.col("p")[i], F.lit(0.0))
        held = F.greatest(F.aggregate("seen", F.lit(0.0), lambda a, y: a + y) - 1, F.lit(0.0))
        prior = F.log((left + STRENGTH * F.col("above")[i]) / (held + STRENGTH))
        told = [F.when(F.col(k).isNull(), 0.0).when(F.col(k) == name, float(np.log(r))).otherwise(float(np.log((1 - r) / others)) if n > 1 else 0.0) for k, r in RELIABLE.items()]
        terms.append(F.col("ll")[i] + prior + told[0] + told[1])
    out = out.withColumn("post", F.array(*terms))
    names = F.array(*[F.lit(x) for x in languages])
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    top_post = F.array_max("post")
    confidence = 1 / F.aggregate("post", F.lit(0.0), lambda a, y: a + F.exp(y - top_post))
    return out.select(id_col, best(F.col("post")).alias("lang"), confidence.alias("confidence"), "host", "declared", "suffix", best(F.col("ll")).alias("text_lang"))
