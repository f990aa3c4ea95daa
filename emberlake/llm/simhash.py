"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most two bits share a variant at most one bit away from both. So every distinct
fingerprint emits itself and its 64 one-bit variants, rows are shuffled on the variant, and the members of a variant
are linked to the least of them. All members of a variant are within two bits of each other, so these star links
connect what all pairs would, and a variant has 65 distinct members at most: no bucket can grow with a group of copies.
A ball of four bits works alike with 2,081 variants.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import discard, written
from emberlake.llm.components import component_labels

BITS = 64
SHINGLE_WORDS = 3
SEED = 42
#: Shingles whose bits are counted at once: bounds memory on long texts.
BLOCK = 32768


def bit_counts(hashes):
    """How many of the 64-bit hashes have each bit."""
    import numpy as np

    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)


def majority(counts, n: int) -> int:
    """The fingerprint of ``n`` hashes: the bits that over half of them have."""
    import numpy as np

    return sum(1 << k for k in np.flatnonzero(2 * counts > n).tolist())


def fingerprint(text: bytes) -> int:
    """SimHash of one UTF-8 text: bit k is set if over half the hashes of its word shingles have it."""
    import numpy as np
    import xxhash

    found = text.lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if not found:
        return 0
    if len(found) <= SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    n, counts = len(found) - SHINGLE_WORDS + 1, np.zeros(BITS, np.int64)
    for i in range(0, n, BLOCK):
        part = found[i : i + BLOCK + SHINGLE_WORDS - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(SHINGLE_WORDS)), strict=False))
        counts += bit_counts(np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in shingles), "<u8", len(part) - SHINGLE_WORDS + 1))
    return majority(counts, n)


def _fingerprints(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        texts = batch.column(1).cast(pa.binary())
        prints = [fingerprint(t.as_py() or b"") for t in texts]
        yield pa.record_batch([batch.column(0), pa.array(prints, pa.uint64()).view(pa.int64())], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, fp: the 64 bits as a long) for each row of ``docs``, of null and repeated ids too; null and blank texts
    have fingerprint 0. An empty table gives an empty one."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_fingerprints, f"id {rows.schema['id'].dataType.simpleString()}, fp long")


#: Variants of a fingerprint within so many bits; three would be 43,745.
VARIANTS = {0: 1, 1: 65, 2: 2081}


def _masks(bits: int) -> Column:
    """All 64-bit masks of at most ``bits`` bits, as one array of constants."""
    each = [[1 << b for b in c] for k in range(bits + 1) for c in itertools.combinations(range(BITS), k)]
    return F.lit([(m ^ 1 << 63) - (1 << 63) for m in map(sum, each)]).cast("array<long>")


def ball_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between distinct values of ``fp`` that connect all values within ``radius`` bits of each other."""
    if radius % 2 or radius // 2 not in VARIANTS:
        raise ValueError("radius is 0, 2 or 4: every variant lies within half of it")
    nodes = prints.select("fp").filter("fp is not null").distinct()
    if not radius:
        return nodes.select(F.col("fp").alias("a"), F.col("fp").alias("b")).filter("a != b")
    variants = nodes.select("fp", F.explode(_masks(radius // 2)).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    stars = variants.select("fp", F.expr("min(fp) over (partition by variant)").alias("hub")).filter("fp != hub")
    return stars.select(F.col("fp").alias("a"), F.col("hub").alias("b")).distinct().filter(f"bit_count(a ^ b) <= {radius}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """One row (id, fp, component_id) for each row of ``docs``.

    ``component_id`` is the least id whose fingerprint is reachable through links of at most ``radius`` bits, the row's
    own included. Rows with a null id keep a row; they take part in links, but only ids that are not null can name a
    component. Repeated rows give repeated rows. An empty table gives an empty one. Other columns are not read.
    """
    prints = written(fingerprints(docs, id_col, text_col), "fingerprints")
    links = ball_links(prints, radius)
    labels = component_labels(links)
    own = written(prints.groupBy("fp").agg(F.min("id").alias("least_id")), "distinct")
    labelled = written(own.join(labels, own.fp == labels.node, "left").select("fp", "least_id", F.coalesce("label", "fp").alias("label")), "labelled")
    named = written(labelled.groupBy("label").agg(F.min("least_id").alias("component_id")), "named")
    by_print = written(labelled.join(named, "label").select("fp", "component_id"), "by_print")
    discard(labels, own, labelled, named)
    return prints.join(by_print, "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """``docs`` without near-duplicates: of each component, the rows of its least id stay.

    Rows with a null id stay, as nothing tells them apart. All columns of ``docs`` are returned unchanged.
    """
    found = near_duplicates(docs, id_col, text_col, radius).filter("id is not null and id != component_id")
    drop = found.select(F.col("id").alias("__drop_id")).distinct()
    return docs.join(drop, docs[id_col] == drop["__drop_id"], "left_anti")
