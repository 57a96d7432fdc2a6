"""Operator 3: exact n-gram Jaccard self-join by vertical partitioning."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .common import components, forget, keep_slots, materialize, row_key, salted_left_join, small_batches

FRAGMENTS = 8
#: Shingles are counted in 2^22 buckets, a table of 4 MB; more (up to 2^28) keep the order sharp on very large corpora.
ORDER_BITS = 22
#: Bits of the slices in which the table is summed.
SLICE_BITS = 18
#: Pivots of a place in the first round over open places; each later round takes 32 times as many.
FIRST_PIVOTS = 8
#: Rows that one part of a frequent shingle's place holds.
PLACE_ROWS = 1 << 16
#: Longest sketch of a set, in 64-bit words.
SKETCH_WORDS = 1024


def _sets(batches: Iterator[pa.RecordBatch], n: int):
    """(ids, shingles, bounds) chunk by chunk; ids and the other columns stay Arrow arrays."""
    for batch in batches:
        data, offsets = kernel.buffers(batch.column(batch.schema.get_field_index("text")))
        for a, b in kernel.chunks(offsets):
            h, bounds = kernel.shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], n)
            yield batch.slice(a, b - a), h, bounds


def _fingerprints(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """One 64-bit value for each set; 0 for the empty set."""
    mixed = np.concatenate((np.zeros(1, np.uint64), np.cumsum(kernel.mix(h ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64)))
    size = np.diff(bounds)
    return np.where(size > 0, kernel.mix((mixed[bounds[1:]] - mixed[bounds[:-1]]) ^ size.astype(np.uint64)), np.uint64(0)).view(np.int64)


def _sketches(h: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Per set the parities of its shingles in at least as many hash buckets (a power of two) as it has shingles, as 64-bit words."""
    size = np.diff(bounds)
    words = np.minimum(1 << np.ceil(np.log2(np.maximum(size, 64) / 64)).astype(np.int64), SKETCH_WORDS)
    ends = np.concatenate((np.zeros(1, np.int64), np.cumsum(words)))
    at = np.repeat(ends[:-1] * 64, size) + ((h >> np.uint64(40)).astype(np.int64) & np.repeat(words * 64 - 1, size))
    parity = (np.bincount(at, minlength=int(ends[-1]) * 64) & 1).astype(np.uint8)
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.packbits(parity, bitorder="little").view(np.int64)))


def _profile(n: int, bits: int):
    """Per document its set size, fingerprint and sketch, and at the end of each task its counts of the shingle buckets, slice by slice."""
    cut = min(bits, SLICE_BITS)

    def run(batches):
        counts = np.zeros(1 << bits, np.uint32)
        for batch, h, bounds in _sets(batches, n):
            at, times = np.unique((h & np.uint64((1 << bits) - 1)).astype(np.uint32), return_counts=True)
            counts[at] += times.astype(np.uint32)
            k = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.diff(bounds)), pa.array(_fingerprints(h, bounds)), _sketches(h, bounds), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], ["doc_id", "key", "size", "node", "sketch", "slice", "counts"])
        parts = counts.reshape(-1, 1 << cut)
        used = [i for i, x in enumerate(parts) if x.any()]
        packed = [pa.compress(parts[i].tobytes(), codec="zstd", asbytes=True) for i in used]
        k = len(used)
        yield pa.RecordBatch.from_arrays([pa.nulls(k, pa.int64()), pa.nulls(k, pa.string()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.list_(pa.int64())), pa.array(used, pa.int32()), pa.array(packed, pa.binary())], ["doc_id", "key", "size", "node", "sketch", "slice", "counts"])

    return run


def _summed(cut: int):
    """Sums the tasks' counts of each slice; a task holds one table for each slice dealt to it."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                part = np.frombuffer(pa.decompress(blob.as_py(), decompressed_size=4 << cut, codec="zstd", asbytes=True), np.uint32)
                sums[i] = sums[i] + part if i in sums else part.astype(np.uint64)
        keys = list(sums)
        # A count's class, eight to an octave, is all that the order needs.
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), pa.array([np.minimum(255, 8 * np.log2(sums[i].astype(float) + 1)).astype(np.uint8).tobytes() for i in keys], pa.binary())], ["slice", "classes"])

    return run


def _in_global_order(h: np.ndarray, bounds: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of each document from rare to frequent; count classes alongside."""
    f = classes[(h & np.uint64(len(classes) - 1)).astype(np.int64)]
    order = np.argsort(np.repeat(np.arange(len(bounds) - 1), np.diff(bounds)) << 8 | f, kind="stable")
    return h[order], f[order]


def _prefixes(n: int, percent: int, classes):
    """Rows (token, salt, node, size, most) for the prefix of each set in the global order.

    ``most`` is the largest partner a link through this position can have: what
    follows the position must hold the whole overlap. A task gives each set once.
    The rows of a token whose bucket counts more than ``PLACE_ROWS`` are dealt
    by a salt over parts of about that size; all others have salt 0.
    """

    def run(batches):
        f, seen = np.frombuffer(classes.value, np.uint8), set()
        for _, h, bounds in _sets(batches, n):
            size = np.diff(bounds)
            node = _fingerprints(h, bounds)
            h, freq = _in_global_order(h, bounds, f)
            fresh = np.zeros(len(node), bool)
            for i, x in enumerate(node.tolist()):
                if x not in seen:
                    seen.add(x)
                    fresh[i] = True
            take = np.where((size > 0) & fresh, size + (-percent * size // 100) + 1, 0)
            own = np.repeat(np.arange(len(size)), take)
            position = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
            at = bounds[:-1][own] + position
            parts = np.exp2(freq[at] / 8.0).astype(np.int64) // PLACE_ROWS
            salt = np.where(parts > 0, 1 + (node[own] & 0x7FFFFFFF) % (parts + 1), 0)
            most = (size[own] - position) * (100 + percent) // percent - size[own]
            yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(node[own]), pa.array(size[own].astype(np.int32)), pa.array(most.astype(np.int32))], ["token", "salt", "node", "size", "most"])

    return run


def _segments(n: int, cuts: np.ndarray, classes):
    """Rows (node, fragment, segment): a set cut at the fragments of the global order."""

    def run(batches):
        f = np.frombuffer(classes.value, np.uint8)
        for _, h, bounds in _sets(batches, n):
            node = _fingerprints(h, bounds)
            h, freq = _in_global_order(h, bounds, f)
            fragment = np.searchsorted(cuts, freq, side="right")
            doc = np.repeat(np.arange(len(node)), np.diff(bounds))
            start = np.flatnonzero(np.concatenate(([True], (doc[1:] != doc[:-1]) | (fragment[1:] != fragment[:-1])))) if len(h) else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.append(start, len(h)).astype(np.int32)), pa.array(h.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(node[doc[start]]), pa.array(fragment[start].astype(np.int32)), lists], ["node", "fragment", "segment"])

    return run


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, fragments: int = FRAGMENTS, order_bits: int = ORDER_BITS) -> DataFrame:
    """Components of documents whose n-word shingle sets have Jaccard similarity >= percent/100.

    Returns one row per input row: (id, n_shingles, component_id, linked_to), the component
    named by its least id. ``linked_to`` is the least id of a document whose link to this
    one was verified or whose set is the same: every member of a component has one, null
    tells that there is none. It is a component join: pairs already in one component are
    not tested, so a document's number of links is not known.

    Equal sets are one node. All shingles are counted (in 2^order_bits hash buckets,
    a bounded table), which fixes one global order from rare to frequent. A link
    needs a common shingle in the sets' prefixes of that order, at positions that
    leave room for the overlap; sets with such a shingle meet in its place. First
    each set of a place is held against the place's least set, which joins groups
    of copies. Places whose sets are then of one component are closed. Open
    places with the same sets become one; in size bands, sets take turns as
    pivots, 8 in the first round and 32 times as many in each later one, and
    meet the sets of other components. Candidate pairs are verified by vertical
    partitioning: the order is cut into fragments, overlaps are counted per
    fragment and summed per pair. The rounds end when no place holds an untested
    pair between two components, so no link between components is lost, and no
    group is expanded into all its pairs. Before its texts are cut, a pair must
    pass a bound: buckets whose parities differ between two sketches each hold a
    shingle of only one of the sets.

    Words are maximal runs of other than space and \\x09-\\x0D after lower-casing
    A-Z. A text with fewer than n words is one shingle; one without words is
    empty, has size 0 and is linked with nothing. Null text counts as empty. A
    null id takes part but is never a component's name unless all ids are null.
    Rows that repeat an id stay separate rows. An empty table gives an empty
    result.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("key"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        members, labels, links = _classes(rows, n, percent, fragments, order_bits)
    named = members.where("node <> 0").groupBy("node").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("copies"))
    named = _labelled(named, "node", labels, "label")
    names = named.groupBy("label").agg(F.min("least").alias("component"), F.sum("copies").alias("documents")).where("documents > 1")
    least = named.select(F.col("node").alias("b"), F.col("least").alias("partner"))
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    partners = both.join(least, "b").groupBy(F.col("a").alias("node")).agg(F.min("partner").alias("partner"))
    named = salted_left_join(named, names, ["label"], F.col("node"), 4).where("component is not null").join(partners, "node", "left")
    # Of equal sets the first member has its partner elsewhere, if there is one; all others have the first.
    named = named.select("node", "component", F.coalesce("partner", F.when(F.col("copies") > 1, F.col("last"))).alias("partner"), F.col("least").alias("first"), "copies")
    out = salted_left_join(members, named, ["node"], F.col("doc_id"))
    again = (F.col("copies") > 1) & ~F.col("doc_id").eqNullSafe(F.col("first"))
    return out.select(F.col("doc_id").alias(id_col), F.col("size").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.when(again, F.col("first")).otherwise(F.col("partner")).alias("linked_to"))


def _classes(rows: DataFrame, n: int, percent: int, fragments: int, bits: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of rows (doc_id, key, text): their profiles (doc_id, key, size, node, sketch), (node, label) of every node with a link, and the verified links (a, b)."""
    spark = rows.sparkSession
    profile = materialize(rows.mapInArrow(_profile(n, bits), "doc_id long, key string, size long, node long, sketch array<long>, slice int, counts binary"), "profile")
    cut = min(bits, SLICE_BITS)
    table = np.zeros(1 << bits, np.uint8)
    for part in profile.where("slice is not null").select("slice", "counts").repartition(1 << (bits - cut), "slice").mapInArrow(_summed(cut), "slice int, classes binary").collect():
        table[part["slice"] << cut : (part["slice"] + 1) << cut] = np.frombuffer(part["classes"], np.uint8)
    weight = np.bincount(table, minlength=256) * (np.exp2(np.arange(256) / 8.0) - 1)
    cuts = np.unique(np.searchsorted(np.cumsum(weight), weight.sum() * np.arange(1, fragments) / fragments))
    shared = spark.sparkContext.broadcast(table.tobytes())
    members = profile.where("slice is null").drop("slice", "counts")

    postings = rows.select("text").mapInArrow(_prefixes(n, percent, shared), "token long, salt int, node long, size int, most int")
    place = Window.partitionBy("token", "salt").orderBy(F.col("most") < F.col("size"), "node")
    met = postings.select("*", *[F.first(c).over(place).alias(f"x_{c}") for c in ("node", "size", "most")], F.lead("node").over(place).alias("next"))
    met = materialize(met.where("salt > 0 or (x_most >= x_size and (next <> node or x_node <> node))").drop("salt", "next"), "met")
    known = members.where("node <> 0").groupBy("node").agg(F.min("doc_id").alias("first"), F.first("sketch").alias("sketch"))
    wanted = materialize(known.join(met.select("node").distinct(), "node", "left_semi"), "wanted")
    cut_sets: list[DataFrame] = []
    all_links: list[DataFrame] = []

    def judged(pairs: DataFrame, labels: DataFrame | None) -> DataFrame:
        """Adds the links among the pairs to the components so far; sets are cut when a pair first needs them."""
        possible = materialize(_possible(pairs, wanted, percent), "pairs")
        if labels is not None and possible.isEmpty():
            forget(possible)
            return labels
        nodes = possible.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        for x in cut_sets:
            nodes = nodes.join(x.select("node"), "node", "left_anti")
        first = wanted.join(nodes, "node", "left_semi").select(F.col("first").alias("doc_id")).distinct()
        texts = keep_slots(rows, first, ["doc_id"]).join(first, rows["doc_id"].eqNullSafe(first["doc_id"]), "left_semi").select("text")
        cut_sets.append(materialize(texts.mapInArrow(_segments(n, cuts, shared), "node long, fragment int, segment array<long>"), "segments"))
        found = materialize(_linked(possible, reduce(DataFrame.unionByName, cut_sets), percent, len(cuts) + 1), "links")
        forget(possible)
        if labels is None:
            labels = components(found)
        elif not found.isEmpty():
            before, labels = labels, components(found.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))
            forget(before)
        all_links.append(found)
        return labels

    fits = "x_size <= size and x_size <= most and size <= x_most or size <= x_size and size <= x_most and x_size <= most"
    labels = judged(_pairs(met.where(f"node <> x_node and ({fits})"), "x_node", "x_size"), None)

    band = lambda c: F.floor(F.log(c.cast("double")) / float(np.log(100 / percent))).cast("int")
    here = met.groupBy("token", "node").agg(F.max("size").alias("size"), F.max("most").alias("most"))
    here = _open(_labelled(here, "node", labels, "label"), ["token"])
    here = here.withColumn("band", F.explode(F.sequence(band(F.ceil(F.col("size") * percent / 100)), band(F.col("size")))))
    here = here.withColumn("pivot", (F.col("most") >= F.col("size")) & (F.col("band") == band(F.col("size"))))
    marks = [F.sum(F.shiftright(F.xxhash64(F.lit(i), "node", "pivot"), 20)).alias(f"s{i}") for i in (1, 2)]
    lists = here.groupBy("token", "band").agg(F.min("label").alias("l"), F.max("label").alias("m"), F.count(F.lit(1)).alias("sets"), F.sum(F.col("pivot").cast("int")).alias("pivots"), *marks)
    alike = Window.partitionBy("sets", "s1", "s2")
    lists = lists.where("l <> m and pivots > 0").select("token", "band", "pivots", F.min(F.struct("token", "band")).over(alike).alias("place"))
    rest = here.join(lists, ["token", "band"]).groupBy("place", "pivots", "node").agg(F.max("size").alias("size"), F.max("most").alias("most"), F.max("pivot").alias("pivot"))
    turn = F.floor(F.shiftrightunsigned(F.xxhash64("node", "token"), 33) / float(1 << 31) * F.col("pivots")).cast("int")
    rest = rest.select("place.*", "node", "size", "most", "pivot", "pivots").select("token", "band", "node", "size", "most", F.when(F.col("pivot"), turn).alias("turn"))
    rest = materialize(rest, "rest")
    forget(met)
    done, width = 0, FIRST_PIVOTS
    while True:
        left = materialize(_open(_labelled(rest, "node", labels, "label"), ["token", "band"], f"last_turn >= {done}", F.max("turn").alias("last_turn")), "rest")
        forget(rest)
        if left.isEmpty():
            break
        now = left.where((F.col("turn") >= done) & (F.col("turn") < done + width)).select("token", "band", F.col("node").alias("p"), F.col("size").alias("p_size"), F.col("most").alias("p_most"), F.col("label").alias("p_label"))
        pairs = left.join(now, ["token", "band"]).where("label <> p_label and p_size <= size and p_size <= most and size <= p_most")
        labels = judged(_pairs(pairs, "p", "p_size"), labels)
        rest, done, width = left.drop("label"), done + width, width * 32
    for x in (left, wanted, *cut_sets):
        forget(x)
    shared.unpersist()
    return members, labels, reduce(DataFrame.unionByName, all_links)


def _pairs(rows: DataFrame, other: str, other_size: str) -> DataFrame:
    return rows.select(F.least("node", other).alias("a"), F.greatest("node", other).alias("b"), (F.col("size") + F.col(other_size)).alias("both")).distinct()


def _open(rows: DataFrame, place: list[str], also: str = "true", *more: Column) -> DataFrame:
    """The rows of places that still hold two components."""
    places = rows.groupBy(*place).agg(F.min("label").alias("l"), F.max("label").alias("m"), *more).where(f"l <> m and {also}").select(*place)
    return rows.join(places, place, "left_semi")


def _labelled(rows: DataFrame, node: str, labels: DataFrame, name: str) -> DataFrame:
    """Adds the component so far of a node; a node without links is its own."""
    return rows.join(labels.select(F.col("node").alias(node), F.col("label").alias(name)), node, "left").withColumn(name, F.coalesce(name, node))


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs that may reach the similarity, by the parities that differ between their sketches; longer sketches are folded."""
    a, b = nodes.select(F.col("node").alias("a"), F.col("sketch").alias("ka")), nodes.select(F.col("node").alias("b"), F.col("sketch").alias("kb"))
    folded = lambda k: f"aggregate(sequence(i, size({k}) - 1, least(size(ka), size(kb))), 0L, (x, j) -> x ^ {k}[j])"
    differ = F.expr(f"aggregate(sequence(0, least(size(ka), size(kb)) - 1), 0, (t, i) -> t + bit_count({folded('ka')} ^ {folded('kb')}))")
    return pairs.join(a, "a").join(b, "b").where(differ * (100 + percent) <= F.col("both") * (100 - percent)).select("a", "b", "both")


def _linked(pairs: DataFrame, segments: DataFrame, percent: int, fragments: int) -> DataFrame:
    """Pairs that reach the similarity: overlaps per fragment, summed per pair."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    segments = keep_slots(segments, ends, ["node"])
    a, b = segments.select(F.col("node").alias("a"), "fragment", F.col("segment").alias("sa")), segments.select(F.col("node").alias("b"), "fragment", F.col("segment").alias("sb"))
    parts = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(fragments - 1)))).join(a, ["a", "fragment"]).join(b, ["b", "fragment"])
    # A set may have been cut more than once; each of its fragments counts once.
    parts = parts.select("a", "b", "both", "fragment", F.size(F.array_intersect("sa", "sb")).alias("part")).groupBy("a", "b", "both", "fragment").agg(F.max("part").alias("part"))
    sums = parts.groupBy("a", "b", "both").agg(F.sum("part").alias("overlap"))
    return sums.where(F.col("overlap") * 100 >= (F.col("both") - F.col("overlap")) * percent).select("a", "b")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """The documents that stay, in their own columns: of every component the one with the least id.

    Texts without words all stay. Null ids come last. Of rows that share the
    least id one stays, whatever the ids elsewhere; rows equal in id and text
    count once.
    """
    keyed = docs.withColumn("__key", F.concat_ws(":", *[row_key(id_col, text_col)[k] for k in ("k1", "k2")]))
    rows = keyed.select(F.col(id_col).cast("long").alias("doc_id"), F.col("__key").alias("key"), F.col(text_col).alias("text"))
    with small_batches(docs.sparkSession):
        members, labels, _ = _classes(rows, n, percent, FRAGMENTS, ORDER_BITS)
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key"))
    nodes = members.where("node <> 0").groupBy("node").agg(first.alias("first"))
    kept = _labelled(nodes, "node", labels, "label").groupBy("label").agg(F.min("first").alias("first")).select(F.col("first.key").alias("__key"))
    kept = kept.unionByName(members.where("node = 0").select(F.col("key").alias("__key"))).distinct()
    return keyed.join(kept, "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns)
