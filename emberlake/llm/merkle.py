"""A Merkle manifest of a dataset, and proofs of all its rows by octopus multiproofs.

Every row is a leaf: a digest of its named fields. The leaves of a tree (a language) ascend by id; every ARITY consecutive
nodes become the digest of their digests until one is left, the subroot. The subroots, ordered by name, make the root in
the same way. All nodes are kept in one table (tree, level, idx, digest), TOP being the tree of subroots.

Leaves are opened by partitions of BLOCK consecutive ones at most. A partition works out which nodes it can't derive from
its own leaves, level by level up to the root: the least union of coordinates that all its proofs need. These are fetched by
one join for all partitions, each coordinate once a partition; then the partition derives the interior nodes that its
proofs share once, and expands the proof of each leaf from them. For a whole block of 4,096 leaves that is seven nodes a
level above the fourth, where single proofs would fetch seven a level for each leaf.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import discard, quoted, reads, small, written
from emberlake.operators import ranges

ARITY = 8
#: Leaves of a partition at most.
BLOCK = ARITY**4
#: The number of the tree of subroots.
TOP = -1
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def field(value: Column) -> Column:
    """A null as ``-``, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(values: Sequence[Column]) -> Column:
    """The digest of a row's fields one after the other: no two rows of different fields have one text."""
    return F.sha2(F.concat(*map(field, values)).cast("binary"), 256)


def missing(known: Sequence[int], width: int, level: int = 0) -> list[tuple[int, int]]:
    """Coordinates (level, idx) that a tree of ``width`` nodes at ``level`` must give to whoever has the nodes ``known`` of it."""
    out, have = [], sorted(set(known))
    while width > 1:
        runs = sorted({k // ARITY for k in have})
        own = set(have)
        out += [(level, k) for r in runs for k in range(r * ARITY, min((r + 1) * ARITY, width)) if k not in own]
        have, width, level = runs, -(-width // ARITY), level + 1
    return out


class Branch:
    """The nodes of one tree above some known nodes, with what proofs need of them; ``fetched`` has what is missing."""

    def __init__(self, known: dict[int, str], width: int, fetched: dict[tuple[int, int], str]):
        self.levels: list[tuple[dict[int, str], int]] = []
        self.siblings, self.proof = functools.cache(self._siblings), functools.cache(self._proof)  # shared by the leaves below
        nodes = dict(known)
        while width > 1:
            nodes |= {k: d for (lv, k), d in fetched.items() if lv == len(self.levels)}
            self.levels.append((nodes, width))
            runs = {k // ARITY for k in known}
            known = {r: digest("".join(nodes[k] for k in self.run(r, width))) for r in runs}
            nodes, width = dict(known), -(-width // ARITY)
        self.root = next(iter(known.values()))

    @staticmethod
    def run(r: int, width: int) -> range:
        return range(r * ARITY, min((r + 1) * ARITY, width))

    def _siblings(self, level: int, k: int) -> tuple[str, str]:
        """What stands before and after a node in its run."""
        nodes, width = self.levels[level]
        run = self.run(k // ARITY, width)
        return "".join(nodes[x] for x in run if x < k), "".join(nodes[x] for x in run if x > k)

    def _proof(self, level: int, k: int) -> str:
        """All siblings from a node up to the root, left to right and level by level; shared from the second level on."""
        if level == len(self.levels):
            return ""
        return "".join(self.siblings(level, k)) + self.proof(level + 1, k // ARITY)

    def folded(self, k: int, own: str) -> str:
        """The root that a node's digest gives with the siblings of its place."""
        for level in range(len(self.levels)):
            before, after = self.siblings(level, k)
            own, k = digest(before + own + after), k // ARITY
        return own


def _parents(nodes: DataFrame) -> DataFrame:
    """The next level of the trees that have more than one node; runs are of ARITY nodes at most."""
    ordered = F.array_sort(F.collect_list(F.struct("idx", "digest")))
    joined = F.concat_ws("", F.transform(ordered, lambda n: n["digest"]))
    up = nodes.filter("width > 1").groupBy("tree", F.floor(F.col("idx") / ARITY).alias("idx"), F.ceil(F.col("width") / ARITY).alias("width"))
    return up.agg(F.sha2(joined.cast("binary"), 256).alias("digest")).select("tree", "idx", "digest", "width")


def _levels(leaves: DataFrame, tag: str) -> list[DataFrame]:
    """Tables (tree, idx, digest, width) of each level above ``leaves``, the last of roots alone."""
    out, now = [], leaves
    while True:
        now = written(_parents(now), tag)
        if now.isEmpty():
            discard(now)
            return out
        out.append(now)


class Manifest:
    """``trees`` (tree, name, width, subroot), ``leaves`` (tree, idx, width and what was kept of a row), ``nodes`` and ``root``."""

    def __init__(self, trees: DataFrame, leaves: DataFrame, nodes: DataFrame, root: str | None, n_trees: int, tables: list[DataFrame]):
        self.trees, self.leaves, self.nodes, self.root, self.n_trees, self.tables = trees, leaves, nodes, root, n_trees, tables


def build(docs: DataFrame, values: Sequence[Column], tree: Column, id_col: str = "doc_id", also: dict[str, Column] | None = None) -> Manifest:
    """The manifest of ``docs``: one leaf for each row, of the named ``values``.

    Trees are ordered by name bytewise, the null first; leaves by id, nulls first, rows of one id by their digests, so that
    equal rows have leaves side by side. No rows, no tree and no root. ``also`` are columns kept with the leaves.
    """
    made = docs.select(tree.cast("string").alias("name"), F.col(quoted(id_col)).alias("id"), leaf(values).alias("digest"), *(c.alias(k) for k, c in (also or {}).items()))
    ranked = ranges.placed(made, [("id", True), ("digest", True)], "name")
    first = written(ranked.withColumnRenamed("place", "idx"), "leaves")
    counts = written(first.groupBy("name").agg(F.count("*").alias("width")), "widths")
    ordered = ranges.placed(counts, [("name", True)])
    trees = written(ordered.select(F.col("place").alias("tree"), "name", "width"), "trees")
    named = small(trees.select("tree", F.col("name").alias("its_name"), "width"))
    leaves = written(first.join(named, F.col("name").eqNullSafe(F.col("its_name"))).drop("its_name"), "tree-leaves")
    discard(first, counts, ranked, ordered)
    bottom = leaves.select("tree", "idx", "digest", "width")
    above = _levels(bottom, "nodes")
    subroots = bottom.filter("width = 1")
    for level in above:
        subroots = subroots.unionByName(level.filter("width = 1"))
    n_trees = trees.count()
    subroots = written(subroots.select("tree", F.col("digest").alias("subroot")), "subroots")
    tops = written(subroots.select(F.lit(TOP).cast("long").alias("tree"), F.col("tree").alias("idx"), F.col("subroot").alias("digest"), F.lit(n_trees).cast("long").alias("width")), "tops")
    crown = _levels(tops, "crown")
    root = ((crown or [tops])[-1]).select("digest").first()
    nodes = None
    for number, level in [*enumerate([bottom, *above]), *enumerate([tops, *crown])]:
        one = level.select("tree", F.lit(number).alias("level"), "idx", "digest")
        nodes = one if nodes is None else nodes.unionByName(one)
    kept = trees.join(small(subroots), "tree")
    return Manifest(kept, leaves, nodes, root and root["digest"], n_trees, [trees, leaves, subroots, tops, *above, *crown])


def _wanted(n_trees: int, table):
    """The least union of coordinates that the leaves of one partition need."""
    import pyarrow as pa

    tree, block, width = (table.column(c)[0].as_py() for c in ("tree", "block", "width"))
    inside = [(tree, level, k) for level, k in missing(table.column("idx").to_pylist(), width)]
    above = [(TOP, level, k) for level, k in missing([tree], n_trees)]
    trees, levels, places = zip(*(inside + above), strict=True) if inside or above else ((), (), ())
    arrays = [pa.array(trees, pa.int64()), pa.array(levels, pa.int32()), pa.array(places, pa.int64()), pa.array([tree] * len(trees), pa.int64()), pa.array([block] * len(trees), pa.int64())]
    return pa.table(arrays, names=["tree", "level", "idx", "for_tree", "block"])


def _expanded(n_trees: int, root: str, leaves, fetched):
    """Proofs of the leaves of one partition, from its own leaves and what it fetched."""
    import pyarrow as pa

    if not leaves.num_rows:
        return pa.table([leaves.column("id"), *([pa.array([], pa.string())] * 5), pa.array([], pa.bool_())], names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
    tree, width = leaves.column("tree")[0].as_py(), leaves.column("width")[0].as_py()
    got: dict[bool, dict[tuple[int, int], str]] = {True: {}, False: {}}
    for t, level, k, d in zip(*(fetched.column(c).to_pylist() for c in ("tree", "level", "idx", "digest")), strict=True):
        got[t == TOP][level, k] = d
    places, digests, changed = (leaves.column(c).to_pylist() for c in ("idx", "digest", "changed"))
    inner = Branch(dict(zip(places, digests, strict=True)), width, got[False])
    outer = Branch({tree: inner.root}, n_trees, got[True])
    last = outer.proof(0, tree)
    proofs = [digest(inner.proof(0, k) + last) for k in places]
    # the fold of an unchanged leaf walks its own path too: it must come to the root
    folded = [outer.folded(tree, inner.folded(k, own if new is None else new)) for k, own, new in zip(places, digests, changed, strict=True)]
    n = len(places)
    arrays = [leaves.column("id"), leaves.column("digest"), pa.array([inner.root] * n), pa.array([root] * n), pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded])]
    return pa.table(arrays, names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def prove(manifest: Manifest, opened: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of the leaves ``opened`` (by default all).

    ``opened`` are rows of ``manifest.leaves``, any of them, with the column ``changed``: the digest that a tampered row
    gives, null for a row as it was. ``proof_sha256`` is the digest of all siblings from the leaf to the root, and
    ``folded_root`` what the (tampered) leaf gives with them. No leaves, no rows.
    """
    leaves = manifest.leaves if opened is None else opened
    if "changed" not in leaves.columns:
        leaves = leaves.withColumn("changed", F.lit(None).cast("string"))
    leaves = leaves.withColumn("block", F.floor(F.col("idx") / block))
    n_trees = manifest.n_trees
    wanted = leaves.select("tree", "block", "idx", "width").groupBy("tree", "block").applyInArrow(lambda t: _wanted(n_trees, t), "tree long, level int, idx long, for_tree long, block long")
    fetched = written(wanted.join(manifest.nodes, ["tree", "level", "idx"]), "fetched")
    kind = leaves.schema["id"].dataType.simpleString()
    out = f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    root = manifest.root or ""
    mine = leaves.select("tree", "block", "idx", "width", "id", "digest", "changed").withColumn("for_tree", F.col("tree"))
    return reads(mine.groupBy("for_tree", "block").cogroup(fetched.groupBy("for_tree", "block")).applyInArrow(lambda a, b: _expanded(n_trees, root, a, b), out), fetched)


def tampered_manifest(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The proofs of all rows of ``docs``, a third of them (by the CRC-32 of the id) checked after their letters A-Z were lowered.

    A row whose text has none of them, or a null text, or a null id stays as it was and verifies. Equal rows have leaves of
    their own; columns that aren't fields of a leaf are not read; bytes that are not UTF-8 count as they are.
    """
    capitals = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    names = [id_col if f == "doc_id" else text_col if f == "text" else f for f in FIELDS]
    values = [F.col(quoted(n)) for n in names]
    lowered = [F.translate(F.col(quoted(n)).cast("string"), capitals, capitals.lower()) if n == text_col else F.col(quoted(n)) for n in names]
    chosen = F.crc32(F.col(quoted(id_col)).cast("string").cast("binary")) % 3 == 0
    manifest = build(docs, values, F.col("lang"), id_col, {"changed": F.when(chosen, leaf(lowered))})
    proofs = prove(manifest)
    return reads(proofs, *proofs.read_from, *manifest.tables)
