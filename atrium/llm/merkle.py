"""Operator 13: a Merkle manifest of a table, levels kept as concatenated hex strings."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, materialize, salted_left_join

# Fixed values of the contract: children of a node, hex digits of a digest.
ARITY = 8
HEX = 64
#: Levels of a block: ARITY ** LEVELS leaves, whose digests make a string of 32 KB.
LEVELS = 3
BLOCK = ARITY**LEVELS


def sized(value: Column) -> Column:
    """A field's part of a leaf: byte count, a colon and the value; ``-`` for null."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_hash(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[sized(c) for c in fields]), 256)


def _level_above(level: Column) -> Column:
    """The next level: every ARITY consecutive digests of a level (binary hex text) become the hash of their text."""
    run = ARITY * HEX
    parents = F.transform(F.sequence(F.lit(0), F.floor((F.octet_length(level) - 1) / run)), lambda i: F.sha2(F.substring(level, (i * run + 1).cast("int"), F.lit(run)), 256))
    return F.array_join(parents, "").cast("binary")


def _flanks(level: Column, at: Column) -> Column:
    """What stands left and right of a digest within its run: the siblings."""
    start = (at - at % ARITY).cast("int")
    left = F.substring(level, start * HEX + 1, ((at - start) * HEX).cast("int"))
    right = F.substring(level, ((at + 1) * HEX + 1).cast("int"), ((start + ARITY - 1 - at) * HEX).cast("int"))
    return F.struct(left.alias("left"), right.alias("right"))


def ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds ``at`` (rank from 0 within the group) and ``total`` (rows of the group).

    Rows are dealt by ranges of (group, order) and sorted there, so a rank is a
    row's number in its partition plus the group's rows in the partitions before.
    """
    cols = [group, *order]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = materialize(rows.repartitionByRange(n, *cols).sortWithinPartitions(*cols).withColumn("__seq", F.monotonically_increasing_id()), "ranges")
    placed = placed.withColumn("__part", F.shiftright("__seq", 33))
    counts = placed.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__n"), F.min("__seq").alias("__first"))
    whole = Window.partitionBy(group)
    before = F.sum("__n").over(whole.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(group, "__part", "__first", F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__n").over(whole).alias("total"))
    out = placed.join(counts, [group, "__part"])
    return out.withColumn("at", F.col("__before") + F.col("__seq") - F.col("__first")).drop("__seq", "__part", "__first", "__before")


def _blocks(nodes: DataFrame, carry: list[str]) -> DataFrame:
    """Aligned blocks of up to BLOCK neighbouring nodes: (grp, block, total, items, l0 .. lLEVELS, applied).

    ``items``: array of (at, carried); ``l0``: the nodes as one string, in order;
    the levels above follow from it. A group that is one block ends at its single
    node; in all others a block has LEVELS levels, be its last runs ever so short.
    """
    item = F.struct((F.col("at") % BLOCK).cast("int").alias("at"), "node", *carry)
    out = nodes.groupBy("grp", F.floor(F.col("at") / BLOCK).alias("block")).agg(F.first("total").alias("total"), F.array_sort(F.collect_list(item)).alias("items"))
    out = out.withColumn("l0", F.array_join(F.transform("items", lambda x: x["node"]), "").cast("binary")).withColumn("applied", F.lit(0))
    out = out.withColumn("items", F.transform("items", lambda x: F.struct(x["at"].alias("at"), *[x[c].alias(c) for c in carry])))
    for k in range(LEVELS):
        more = (F.col("total") > BLOCK) | (F.octet_length(f"l{k}") > HEX)
        out = out.withColumn(f"l{k + 1}", F.when(more, _level_above(F.col(f"l{k}"))).otherwise(F.col(f"l{k}"))).withColumn("applied", F.col("applied") + more.cast("int"))
    return out


def _climb(at: Column) -> Column:
    """The siblings that a node of a block meets on its way up the block."""
    steps = [F.when(F.col("applied") > k, _flanks(F.col(f"l{k}"), F.floor(at / ARITY**k))) for k in range(LEVELS)]
    return F.array_compact(F.array(*steps))


def _top(blocks: DataFrame) -> Column:
    return F.col(f"l{LEVELS}").cast("string")


def climbs(nodes: DataFrame) -> DataFrame:
    """Of nodes (grp, at, total, node): (grp, at, climb, root), the siblings up to the group's root, level by level."""
    most = nodes.agg(F.max("total")).first()[0] or 0
    blocks = _blocks(nodes, [])
    root = F.when(F.col("total") <= BLOCK, _top(blocks))
    if most <= BLOCK:
        out = blocks.select("grp", root.alias("root"), F.transform("items", lambda x: F.struct(x["at"].cast("long").alias("at"), _climb(x["at"]).alias("climb"))).alias("x"))
        return out.select("grp", "root", F.explode("x").alias("x")).select("grp", "x.at", "x.climb", "root")
    blocks = materialize(blocks, "blocks")
    above = climbs(_roots(blocks)).withColumnsRenamed({"at": "block", "climb": "rest", "root": "top"})
    joined = blocks.join(above, ["grp", "block"], "left")
    way = F.transform("items", lambda x: F.struct((x["at"] + F.col("block") * BLOCK).alias("at"), F.concat(_climb(x["at"]), F.coalesce("rest", F.array().cast("array<struct<left:binary,right:binary>>"))).alias("climb")))
    out = joined.select("grp", F.coalesce("top", _top(blocks)).alias("root"), F.explode(way).alias("x"))
    return out.select("grp", "x.at", "x.climb", "root")


def _roots(blocks: DataFrame) -> DataFrame:
    """The blocks' own roots as nodes of the tree above, where a group has several blocks."""
    return blocks.where(F.col("total") > BLOCK).select("grp", F.col("block").alias("at"), F.ceil(F.col("total") / BLOCK).alias("total"), _top(blocks).alias("node"))


def manifest(docs: DataFrame, fields: list[str], tampered: dict[str, Column], when: Column, id_col: str = "doc_id", group_col: str = "lang") -> DataFrame:
    """A Merkle tree per group and one over the groups, with each row's proof and what folding it gives.

    Returns (id, leaf, subroot, root, proof_sha256, folded_root, verified), one row per input row.
    A leaf hashes the fields, each as its byte count, a colon and the value (``-`` for null). A group's leaves stand in
    order of the id; while several nodes are left, every 8 neighbours become the hash of their text. The groups' roots, ordered by
    the group's bytes with null first, make the tree above. A proof is the siblings from the leaf to the root, left
    to right, level by level; its hash is given. Rows for which ``when`` holds get a second leaf, with
    the fields in ``tampered`` in place of their own; folding takes that leaf and the original siblings.

    Each aligned block of 512 nodes keeps a level as one hex string: parents hash its fixed-width substrings,
    siblings are the substrings beside a digest, and the blocks' roots make the next tree. Ranks come from sorted
    ranges, so no group is one task.

    Null ids come first, rows with equal ids are ordered by their leaves; equal leaves of one id are the same in any
    order and each has its own place. A null group is a group of its own and not the empty text. A null ``when`` counts
    as false. Null and very long texts are hashed whole. Other columns are ignored. An empty table gives an empty
    result.
    """
    swapped = [tampered.get(c, F.col(c)) for c in fields]
    other = F.when(F.coalesce(when, F.lit(False)), leaf_hash(swapped))
    group = F.when(F.col(group_col).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(group_col).cast("string")))
    leaves = docs.select(F.col(id_col).alias("id"), group.alias("grp"), leaf_hash([F.col(c) for c in fields]).alias("node"), other.alias("other"), F.monotonically_increasing_id().alias("row"))
    leaves = materialize(leaves, "leaves")
    blocks = materialize(_blocks(ranked(leaves, "grp", ["id", "node", "row"]), ["id", "other"]), "leaf-blocks")
    forget(leaves)
    above = materialize(climbs(_roots(blocks)), "climbs")
    single = blocks.where(F.col("total") <= BLOCK).select("grp", _top(blocks).alias("node"))
    subroots = single.unionByName(above.where("at = 0").select("grp", F.col("root").alias("node")))
    names = ranked(subroots.select(F.lit("").alias("all"), F.col("grp").alias("name"), "node"), "all", ["name"])
    top = climbs(names.withColumnRenamed("all", "grp").drop("name"))
    last = materialize(names.join(top.select("at", "climb", "root"), "at").select(F.col("name").alias("grp"), F.col("node").alias("subroot"), F.col("climb").alias("last"), "root"), "subroots")
    joined = blocks.join(above.select("grp", F.col("at").alias("block"), F.col("climb").alias("rest")), ["grp", "block"], "left")
    joined = salted_left_join(joined, last, ["grp"], F.col("block"))
    return _proved(joined, id_col)


def _proved(blocks: DataFrame, id_col: str) -> DataFrame:
    none = F.array().cast("array<struct<left:binary,right:binary>>")
    upper = F.concat(F.coalesce("rest", none), F.coalesce("last", none))
    leaf = lambda x: F.substring(F.col("l0"), x["at"] * HEX + 1, F.lit(HEX)).cast("string")
    ways = F.transform("items", lambda x: F.struct(x["id"].alias("id"), leaf(x).alias("leaf"), F.coalesce(x["other"], leaf(x)).alias("node"), F.concat(_climb(x["at"]), F.col("upper")).alias("climb")))

    def folded(x: Column) -> Column:
        return F.aggregate(x["climb"], x["node"], lambda node, s: F.sha2(F.concat(s["left"], node.cast("binary"), s["right"]), 256))

    proof = lambda x: F.sha2(F.aggregate(x["climb"], F.lit("").cast("binary"), lambda out, s: F.concat(out, s["left"], s["right"])), 256)
    told = F.transform(ways, lambda x: F.struct(x["id"].alias("id"), x["leaf"].alias("leaf"), proof(x).alias("proof"), folded(x).alias("folded")))
    out = blocks.withColumn("upper", upper).select("subroot", "root", F.explode(told).alias("x"))
    return out.select(F.col("x.id").alias(id_col), F.col("x.leaf").alias("leaf"), "subroot", "root", F.col("x.proof").alias("proof_sha256"), F.col("x.folded").alias("folded_root"), (F.col("x.folded") == F.col("root")).alias("verified"))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


#: crc32 of a short ASCII text (the decimal doc_id) bit by bit, in DuckDB.
_CRC = """xor(list_reduce(list_concat([4294967295::bigint], flatten(list_transform(string_split(doc_id::varchar, ''), lambda c: [ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1]))),
          lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295)"""


def _leaf_sql(text: str) -> str:
    part = lambda c: f"coalesce(strlen({c})::varchar || ':' || {c}, '-')"
    return "sha256(" + " || ".join(part(c) for c in ("doc_id::varchar", "source", "lang", "n_chars::varchar", text)) + ")"


MANIFEST_SQL = f"""
WITH RECURSIVE doc AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS grp, {_leaf_sql('text')} AS leaf,
         CASE WHEN {_CRC} % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM doc),
tree(grp, lvl, pos, node, n) AS (
  SELECT grp, 0, pos, leaf, count(*) OVER (PARTITION BY grp) FROM placed
  UNION ALL SELECT grp, lvl, pos, node, count(*) OVER (PARTITION BY grp) FROM (
    SELECT grp, lvl + 1 AS lvl, pos // 8 AS pos, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM tree WHERE n > 1 GROUP BY grp, lvl, pos // 8)),
subroot AS (SELECT grp, node, lvl AS height, row_number() OVER (ORDER BY grp) - 1 AS pos FROM tree WHERE n = 1),
crown(lvl, pos, node, n) AS (
  SELECT 0, pos, node, count(*) OVER () FROM subroot
  UNION ALL SELECT lvl, pos, node, count(*) OVER () FROM (
    SELECT lvl + 1 AS lvl, pos // 8 AS pos, sha256(string_agg(node, '' ORDER BY pos)) AS node FROM crown WHERE n > 1 GROUP BY lvl, pos // 8)),
lvls AS (SELECT p.r, s.lvl FROM placed p JOIN subroot b USING (grp), unnest(range(0, b.height)) s(lvl)),
sib AS (
  SELECT p.r, l.lvl, coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos < p.pos // CAST(pow(8, l.lvl) AS bigint)), '') AS lo,
         coalesce(string_agg(t.node, '' ORDER BY t.pos) FILTER (t.pos > p.pos // CAST(pow(8, l.lvl) AS bigint)), '') AS hi
  FROM placed p JOIN lvls l USING (r) JOIN tree t ON t.grp = p.grp AND t.lvl = l.lvl AND t.pos // 8 = p.pos // CAST(pow(8, l.lvl + 1) AS bigint) GROUP BY p.r, l.lvl, p.pos),
upper AS (
  SELECT b.grp, c.lvl, coalesce(string_agg(c.node, '' ORDER BY c.pos) FILTER (c.pos < b.pos // CAST(pow(8, c.lvl) AS bigint)), '') AS lo,
         coalesce(string_agg(c.node, '' ORDER BY c.pos) FILTER (c.pos > b.pos // CAST(pow(8, c.lvl) AS bigint)), '') AS hi
  FROM subroot b JOIN crown c ON c.n > 1 AND c.pos // 8 = b.pos // CAST(pow(8, c.lvl + 1) AS bigint) GROUP BY b.grp, b.pos, c.lvl),
way AS (SELECT r, lvl, lo, hi FROM sib UNION ALL SELECT p.r, 1000 + u.lvl, u.lo, u.hi FROM placed p JOIN upper u USING (grp)),
steps AS (SELECT r, list(struct_pack(lo := lo, hi := hi) ORDER BY lvl) AS way, string_agg(lo || hi, '' ORDER BY lvl) AS proof FROM way GROUP BY r),
fold(r, i, node) AS (
  SELECT r, 0, coalesce(other, leaf) FROM placed
  UNION ALL SELECT f.r, f.i + 1, sha256(s.way[f.i + 1].lo || f.node || s.way[f.i + 1].hi) FROM fold f JOIN steps s USING (r) WHERE f.i < len(s.way)),
folded AS (SELECT r, arg_max(node, i) AS node FROM fold GROUP BY r),
root AS (SELECT node FROM crown WHERE n = 1)
SELECT p.doc_id, p.leaf, b.node AS subroot, root.node AS root, sha256(coalesce(s.proof, '')) AS proof_sha256, f.node AS folded_root, f.node = root.node AS verified
FROM placed p JOIN subroot b USING (grp) JOIN folded f USING (r) LEFT JOIN steps s USING (r), root"""
