"""Document fingerprints by context-triggered piecewise hashing.

A rolling hash over eight characters sets the chunk boundaries, so an edit changes only the chunks it touches. Each
chunk becomes one symbol of the signature. A fingerprint holds the signatures for a block size (a power of two that
follows the length of the text) and for its double; two fingerprints are compared, at block sizes they share, by the
edit distance (insert and delete 1, replace 2) between signatures.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import decoded, partitions

#: A text is cut into about half to all of so many chunks.
CHUNKS = 64
#: A signature has at most so many symbols; a text that repeats itself is given a larger block size.
MOST = 4 * CHUNKS
SYMBOL = 3
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
BLOCK = 1 << 20


def _rolled(codes):
    """A mixed 64-bit hash of each character and the seven before it."""
    import numpy as np

    h = codes.astype(np.uint64) + np.uint64(1)
    for step, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F), (4, 0x165667B19E3779F9)):
        wide = h * np.uint64(factor)
        wide[step:] += h[:-step]
        h = wide
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def _symbols(rolled, block: int) -> list[int]:
    """A number of 18 bits for each chunk; a chunk ends where the rolling hash is a multiple of ``block``."""
    import numpy as np

    ends = np.flatnonzero((rolled & np.uint64(block - 1)) == 0) + 1
    starts = np.concatenate(([0], ends[: len(ends) - bool(len(ends) and ends[-1] == len(rolled))]))
    sums = np.add.reduceat(rolled, starts) * np.uint64(0x9E3779B97F4A7C15)
    return (sums >> np.uint64(64 - 6 * SYMBOL)).tolist()


def _few(rolled, block: int) -> list[int] | None:
    found = _symbols(rolled, block)
    if len(found) > MOST:  # runs of one symbol say nothing beyond their first three
        found = [x for k, x in enumerate(found) if k < 3 or not x == found[k - 1] == found[k - 2] == found[k - 3]]
    return found if len(found) <= MOST else None


def signature(text: str) -> tuple[int, list[int], list[int]]:
    """The block size and the two signatures of a whole text; an empty text has empty signatures."""
    import numpy as np

    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    if not len(codes):
        return 2, [], []
    # in blocks, with the seven characters before each: bounds the memory that long texts take
    parts = [_rolled(codes[max(0, i - 7) : i + BLOCK])[min(7, i) :] for i in range(0, len(codes), BLOCK)]
    rolled = parts[0] if len(parts) == 1 else np.concatenate(parts)
    block = 2
    while block * CHUNKS < len(codes):
        block *= 2
    while (one := _few(rolled, block)) is None or (two := _few(rolled, 2 * block)) is None:
        block *= 2
    return block, one, two


def encoded(sig: tuple[int, list[int], list[int]]) -> str:
    shown = ["".join(ALPHABET[x >> 6 * k & 63] for x in part for k in reversed(range(SYMBOL))) for part in sig[1:]]
    return f"{sig[0]}:{shown[0]}:{shown[1]}"


def read_back(fingerprint: str) -> tuple[int, list[int], list[int]]:
    """The signatures that ``encoded`` wrote: stored fingerprints can be compared without their texts."""
    block, *shown = fingerprint.split(":")
    symbols = [[ALPHABET.index(c) for c in part] for part in shown]
    return int(block), *([functools.reduce(lambda x, c: x << 6 | c, part[k : k + SYMBOL], 0) for k in range(0, len(part), SYMBOL)] for part in symbols)


def _common(a: list[int], b: list[int]) -> int:
    """The length of the longest common subsequence, in one integer step for each symbol of ``b``."""
    at: dict[int, int] = {}
    for k, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << k
    if at.keys().isdisjoint(b):
        return 0
    every = (1 << len(a)) - 1
    row = every
    for x in b:
        hit = row & at.get(x, 0)
        row = (row + hit | row - hit) & every
    return len(a) - row.bit_count()


def likeness(a: tuple[int, list[int], list[int]], b: tuple[int, list[int], list[int]]) -> float:
    """1 less the edit distance between signatures over the sum of their lengths; 0 if no block size is shared."""
    if a == b:
        return 1.0
    pairs = [(x, y) for k, x in ((0, a[1]), (1, a[2])) for j, y in ((0, b[1]), (1, b[2])) if a[0] << k == b[0] << j]
    return max((2 * _common(x, y) / (len(x) + len(y)) for x, y in pairs if x and y), default=0.0)


#: Parts for each shuffle partition, and rows that are looked at to place the cuts of a part.
PARTS, LOOKED_AT = 4, 10


def _part(cuts: list, doc_id, h: int) -> tuple[int, tuple]:
    """The part of a row, and its place in the order: nulls first, then by id, rows of one id by a hash of the text."""
    place = (doc_id is not None, doc_id or 0, h)
    return bisect.bisect_right(cuts, place), place


def _heads(cuts: list, batches: Iterator) -> Iterator:
    """The first row (part, id, h) of each part in each batch."""
    import pyarrow as pa

    for batch in batches:
        first: dict[int, tuple] = {}
        for doc_id, h in zip(*(batch.column(k).to_pylist() for k in range(2)), strict=True):
            part, place = _part(cuts, doc_id, h)
            if part not in first or place < first[part][0]:
                first[part] = place, doc_id
        arrays = [pa.array(list(first), pa.int32()), pa.array([x for _, x in first.values()], batch.schema.field(0).type), pa.array([p[2] for p, _ in first.values()], pa.int64())]
        yield pa.record_batch(arrays, names=["part", "id", "h"])


def _dealt(cuts: list, lends: dict, batches: Iterator) -> Iterator:
    """Rows with their part; rows equal to the head of a part once more, for the part before. Equal rows of a batch are one."""
    import pyarrow as pa

    for batch in batches:
        rows: dict[tuple, int] = {}
        for doc_id, h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
            part, place = _part(cuts, doc_id, h)
            row = (part, False, doc_id, h, text.as_py())
            rows[row] = rows.get(row, 0) + 1
            if part in lends and lends[part][0] == place:
                rows[(lends[part][1], True, *row[2:])] = 1
        kinds = [("part", pa.int32()), ("lent", pa.bool_()), ("id", batch.schema.field(0).type), ("h", pa.int64()), ("text", pa.binary())]
        columns = list(zip(*rows, strict=True)) or [()] * 5
        arrays = [pa.array(c, t) for c, (_, t) in zip(columns, kinds, strict=True)]
        yield pa.record_batch([*arrays, pa.array(list(rows.values()), pa.int64())], names=[*(n for n, _ in kinds), "copies"])


def with_next(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (part, lent, id, h, text: bytes, copies) for a sorted pass: parts are ranges, and the first row of each part is
    lent to the part before it, so that every row's successor is at hand. The first row of all is lent to the last part.

    Cuts lie on (id, hash of the text), so that rows with one id, or none, are split like any others; equal rows are
    counted before they move. A few numbers for each partition reach the driver and go to the tasks: never a text.
    """
    spark, n = docs.sparkSession, PARTS * partitions(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).select("id", F.xxhash64("text").alias("h"), "text")
    kind, places = rows.schema["id"].dataType.simpleString(), rows.select("id", "h")
    total = rows.select("id").count()
    looked = places.sample(min(1.0, LOOKED_AT * n / max(total, 1)), 1).collect()
    looked = sorted((r["id"] is not None, r["id"] or 0, r["h"]) for r in looked)
    cuts = sorted({looked[k * len(looked) // n] for k in range(1, n)}) if looked else []
    found = places.mapInArrow(functools.partial(_heads, cuts), f"part int, id {kind}, h long")
    heads = found.groupBy("part").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "h")).alias("x")).orderBy("part").collect()
    lends = {r["part"]: ((r["x"]["known"], r["x"]["id"] or 0, r["x"]["h"]), heads[k - 1]["part"]) for k, r in enumerate(heads)}
    dealt = rows.mapInArrow(functools.partial(_dealt, cuts, lends), f"part int, lent boolean, id {kind}, h long, text binary, copies long")
    return dealt.repartition(partitions(spark), "part").sortWithinPartitions("part", "lent", "id", "h", "text")


def _pass(batches: Iterator) -> Iterator:
    """A row for each own document, from rows sorted by part, with the lent successor at the end of each part."""
    import pyarrow as pa

    def row(doc, following):
        (doc_id, text, sig), (_, then, then_sig) = doc, following
        half = len(text) // 2
        edited = text[: len(text) - half] + then[:half]
        edited_sig = signature(edited)
        return doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), encoded(sig), encoded(edited_sig), likeness(sig, edited_sig), likeness(sig, then_sig)

    held = part = None
    more = 0  # copies of the held row beyond one: each is followed by the next
    for batch in batches:
        out = []
        for at, lent, doc_id, _, text, copies in zip(*(batch.column(k) for k in range(6)), strict=True):
            at, lent = at.as_py(), lent.as_py()
            if lent and held is None:
                continue  # a further lent row with the same id
            text = text.as_py().decode("utf-8", "replace")
            doc = (doc_id.as_py(), text, signature(text))
            if held is not None and at == part:
                out += [row(held, held)] * more if more else []
                out.append(row(held, doc))
            held, part, more = (None if lent else doc), at, copies.as_py() - 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (batch.schema.field(2).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()), strict=True)], ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def compare_with_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its fingerprint, that of its edited text, and likenesses (0 to 1).

    The edited text has the last half of the characters replaced by as many (or all) from the start of the next
    document by ascending id (a number); the last document takes the first. A null text is empty; bytes that are not UTF-8
    count as U+FFFD. Rows with a null id come first; rows with one id are in the order of a hash of their texts. An empty
    table gives no rows; a single row follows itself. Other columns are not read.
    """
    rows = with_next(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_pass, f"id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _prints(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([encoded(signature(t)) for t in decoded(batch.column(1))], pa.string())], names=["id", "fingerprint"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (id, fingerprint) for each row of ``docs``; no shuffle. A null text counts as empty, null and repeated ids keep their rows."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_prints, f"id {rows.schema['id'].dataType.simpleString()}, fingerprint string")


def _compared(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        pairs = zip(*(batch.column(k).to_pylist() for k in (1, 2)), strict=True)
        yield pa.record_batch([batch.column(0), pa.array([None if a is None or b is None else likeness(read_back(a), read_back(b)) for a, b in pairs], pa.float64())], names=["id", "likeness"])


def compare_stored(pairs: DataFrame, a: str, b: str, id_col: str = "id") -> DataFrame:
    """One row (id, likeness: 0 to 1) for each row of ``pairs``, whose columns ``a`` and ``b`` hold fingerprints; a null one gives null."""
    rows = pairs.select(F.col(id_col).alias("id"), F.col(a).alias("a"), F.col(b).alias("b"))
    return rows.mapInArrow(_compared, f"id {rows.schema['id'].dataType.simpleString()}, likeness double")
