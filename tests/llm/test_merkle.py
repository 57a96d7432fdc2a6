"""The Merkle manifest against a plain tree."""

import hashlib
import zlib

from pyspark.sql import functions as F

from atrium.llm import merkle

DOC = "doc_id long, text string, lang string, source string, n_chars long, leaf string, at string, grp string"
FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, text):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def tree(nodes):
    """(root, way of each node): the siblings from the node up."""
    ways, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for i, k in enumerate(at):
            start = k // 8 * 8
            ways[i].append((level[start:k], level[k + 1 : start + 8]))
        level = [h("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
        at = [k // 8 for k in at]
    return level[0], ways


def plain(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    inner = {}
    for g in names:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1])))
        inner[g] = tree([leaf(r, r[1]) for r in groups[g]])
    root, tops = tree([inner[g][0] for g in names])
    out = []
    for g, top in zip(names, tops, strict=True):
        for r, way in zip(groups[g], inner[g][1], strict=True):
            own = leaf(r, r[1])
            node = own
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None:
                node = leaf(r, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r[1]))
            for left, right in way + top:
                node = h("".join(left) + node + "".join(right))
            out.append((r[0], own, inner[g][0], root, h("".join("".join(a + b) for a, b in way + top)), node, node == root))
    return sorted(out, key=str)


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOC)
    out = merkle.manifest(df, FIELDS, {"text": merkle.lower_ascii(F.col("text"))}, F.crc32(F.col("doc_id").cast("string")) % 3 == 0)
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_manifest_equals_a_plain_tree(spark):
    rows = [(i, f"Text {i} Ünï" if i % 5 else None, ["en", "de", None, "", "fr"][i % 7 % 5], f"s{i % 3}" if i % 4 else None, i if i % 6 else None) for i in range(150)]
    rows += [(None, "A", "en", None, None), (None, "B", "en", None, None), (7, "Twice", "en", "s", 1), (7, "Twice", "en", "s", 1), (1000, "Alone", "xx", "s", 1), (-3, "x" * 300_000 + "Q", "de", "", 0)]
    rows += [(2000 + i, "T" * i, f"lang{i}", "s", i) for i in range(70)]
    assert run(spark, rows) == plain(rows)


def test_trees_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "LEVELS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(i * 3 % 601, f"Text {i}", "en" if i % 9 else "de", "s", i) for i in range(601)]
    assert run(spark, rows) == plain(rows)


def test_one_row_and_no_row(spark):
    one = [(5, "One", "en", "s", 3)]
    got = run(spark, one)
    assert got == plain(one)
    assert got[0][1] == got[0][2] == got[0][3]
    assert run(spark, []) == []
