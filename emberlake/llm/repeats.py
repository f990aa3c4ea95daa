"""Removal of byte strings that occur more than once in a corpus, by suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else. One suffix array of a whole corpus fits no
task, so equal strings are brought together first, without loss:

* Every window of LENGTH bytes has an anchor: its least gram of GRAM bytes by a hash, the leftmost of equals. It depends on
  the window alone, so equal windows have equal anchors at one offset. Windows in a row with one anchor are a stretch.
* Stretches are keyed by their anchor's gram. A key of one stretch has no repeat. Where equal stretches have one key, all
  their windows are repeated. What is left are keys with different stretches, of which one occurs once: the borders of
  repeated passages.
* The different stretches of such a key make one string. Suffix arrays of many of these strings are built in step by
  grouping on Lyndon prefixes (``lyndon``). A window is repeated if it equals a neighbour in the order of all windows.
* A key with more than MOST different stretches is parted: its windows are dealt by their offset from the anchor in blocks
  of BLOCKS[0], then BLOCKS[1], and keyed by the bytes that all windows of the block share. In a block of one, equal keys are
  equal windows, so this ends whatever the number of stretches; each step adds rows in proportion to those parted.

Nothing is gathered by key but MOST stretches; hot keys are summed on the map side before they are shuffled.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm import lyndon
from emberlake.llm.common import discard, quoted, reads, small, written

LENGTH = 200
GRAM = 32
#: Different stretches of a key at most that make one string, and windows of a block where there are more.
MOST = 16
BLOCKS = (16, 1)
#: Bytes of texts whose anchors are found at once, and of strings whose suffixes are sorted at once: both bound memory.
TEXT_BLOCK = 1 << 20
SORT_BLOCK = 1 << 20
#: More than the bytes of any stretch.
SPAN = 2 * LENGTH
#: Strings of up to this many stretches are sorted together, as rounds go by the longest string.
FEW = 4
SEED = 42


def _hash(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(data, SEED) - (1 << 63)


def stretches(data: bytes, bounds: list[tuple[int, int]], length: int = LENGTH, gram: int = GRAM):
    """(first window, windows - 1, anchor) of the stretches of all windows inside ``bounds``, in order."""
    import numpy as np

    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 3
    words = np.ndarray((n - 7,), "<u8", data, strides=(1,))
    odd = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xBF58476D1CE4E5B9)]
    m = n - gram + 1
    # words at 0, 8, ... and at the end cover the gram
    mixed = np.zeros(m, np.uint64)
    for k, at in enumerate([*range(0, gram - 8, 8), gram - 8]):
        mixed = (mixed ^ mixed >> np.uint64(31)) * odd[4] + words[at : at + m] * odd[k % 4]
    mixed = (mixed ^ mixed >> np.uint64(29)) * odd[4]
    least = (mixed & np.uint64(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
    width, have = length - gram + 1, 1
    while 2 * have <= width:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < width:
        least = np.minimum(least[: len(least) - (width - have)], least[width - have :])
    anchor = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
    valid = np.zeros(n - length + 3, bool)  # of a window and its neighbours
    for a, b in bounds:
        if b - a >= length:
            valid[a + 1 : b - length + 2] = True
    inside, before, after = valid[1:-1], valid[:-2], valid[2:]
    change = anchor[1:] != anchor[:-1]
    first = np.flatnonzero(inside & (~before | np.append(True, change)))
    last = np.flatnonzero(inside & (~after | np.append(change, True)))
    return first, last - first, anchor[first]


def _pieces(rows, batch) -> Iterator[tuple[bytes, list[tuple[int, int, int, int]]]]:
    """Blocks of texts joined, with (row, place of the piece in its text, begin, end); long texts in pieces that overlap."""
    held, bounds, size = [], [], 0
    for row, text in zip(rows, batch, strict=True):
        data = text.as_py() or b""
        for at in range(0, max(1, len(data) - LENGTH + 1), TEXT_BLOCK):
            piece = data[at : at + TEXT_BLOCK + LENGTH - 1] if len(data) > TEXT_BLOCK else data
            held.append(piece)
            bounds.append((row, at, size, size + len(piece)))
            size += len(piece)
            if size >= TEXT_BLOCK:
                yield b"".join(held), bounds
                held, bounds, size = [], [], 0
    if held:
        yield b"".join(held), bounds


def _anchored(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for data, bounds in _pieces(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            first, more, anchor = stretches(data, [(a, b) for _, _, a, b in bounds])
            if not len(first):
                continue
            which = np.searchsorted(np.array([a for _, _, a, _ in bounds]), first, side="right") - 1
            # bounds of one begin (empty texts) are followed by the piece itself: the last of them
            rows, places, begins = (np.array([b[k] for b in bounds], np.int64)[which] for k in (0, 1, 2))
            keys = [_hash(data[p : p + GRAM]) for p in anchor.tolist()]
            same = [_hash(data[a : a + n + LENGTH]) for a, n in zip(first.tolist(), more.tolist(), strict=True)]
            arrays = [pa.array(rows), pa.array(keys, pa.int64()), pa.array(same, pa.int64()), pa.array(places + first - begins), pa.array(more.astype(np.int16)), pa.array((anchor - first).astype(np.int16))]
            yield pa.record_batch(arrays, names=["row", "key", "same", "at", "more", "off"])


def _cut_out(batches: Iterator) -> Iterator:
    """The bytes of stretches, from texts with the list of theirs."""
    import pyarrow as pa

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.binary()]
    names = ["key", "same", "copies", "different", "more", "off", "data"]
    for batch in batches:
        rows = []
        for text, wanted in zip(batch.column(0).cast(pa.binary()), batch.column(1), strict=True):
            data = text.as_py() or b""
            for w in wanted.as_py():
                rows.append((w["key"], w["same"], w["copies"], w["different"], w["more"], w["off"], data[w["at"] : w["at"] + w["more"] + LENGTH]))
                if len(rows) >= 10_000:
                    yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                    rows = []
        if rows:
            yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def repeated_windows(groups: list[list[bytes]], length: int = LENGTH) -> list[list[list[int]]]:
    """For each string of each group the windows that also start elsewhere in the group, by one suffix array a group."""
    import numpy as np

    parts, sizes, windows, gap = [], [], [], np.zeros(1, np.uint8)
    for group in groups:
        for data in group:
            parts += [np.frombuffer(data, np.uint8), gap]
            windows.append(max(0, len(data) - length + 1))
        sizes.append(sum(map(len, group)) + len(group) + 1)
        parts.append(gap)
    raw = np.concatenate(parts)
    begins = np.cumsum([0, *sizes])[:-1]
    text = raw.astype(np.int32) + 2
    lengths = np.array([len(d) + 1 for g in groups for d in g])
    # a string begins after those before it, and after the ends of the groups before its own
    of = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    at = np.cumsum(lengths) - lengths + of
    text[at + lengths - 1] = 1
    text[begins + sizes - 1] = 0
    order = lyndon.suffix_array(text, begins)
    windows = np.array(windows)
    is_window, owner = np.zeros(len(text), bool), np.zeros(len(text), np.int64)
    places = np.repeat(at - (np.cumsum(windows) - windows), windows) + np.arange(windows.sum())
    is_window[places] = True
    owner[places] = np.repeat(np.arange(len(at)), windows)
    order = order[is_window[order]]
    repeated = np.zeros(len(text), bool)
    if len(order) > 1:
        view, group = np.lib.stride_tricks.sliding_window_view(raw, length), of[owner[order]]
        for k in range(0, len(order) - 1, 8192):
            a, b = order[k : k + 8192], order[k + 1 : k + 8193]
            a = a[: len(b)]
            same = (view[a] == view[b]).all(axis=1) & (group[k : k + len(b)] == group[k + 1 : k + 1 + len(b)])
            repeated[a[same]] = repeated[b[same]] = True
    hits = np.flatnonzero(repeated)
    out: list[list[int]] = [[] for _ in at]
    for who, place in zip(owner[hits].tolist(), (hits - at[owner[hits]]).tolist(), strict=True):
        out[who].append(place)
    found, k = [], 0
    for group in groups:
        found.append(out[k : k + len(group)])
        k += len(group)
    return found


def runs(places: list[int]) -> list[tuple[int, int]]:
    """Ascending places as runs (first, last)."""
    out: list[tuple[int, int]] = []
    for p in places:
        if out and out[-1][1] == p - 1:
            out[-1] = (out[-1][0], p)
        else:
            out.append((p, p))
    return out


def _sorted_out(batches: Iterator) -> Iterator:
    """(key, same, first, last) runs of repeated windows, from stretches ordered by key."""
    import pyarrow as pa

    waiting: dict[bool, tuple[list, list[int]]] = {True: ([], [0]), False: ([], [0])}
    names = ["key", "same", "first", "last"]

    def solved(few: bool):
        groups, size = waiting[few]
        found = repeated_windows([[d for _, _, d in g] for g in groups])
        rows = [(key, same, a, b) for g, f in zip(groups, found, strict=True) for (key, same, _), places in zip(g, f, strict=True) for a, b in runs(places)]
        groups.clear()
        size[0] = 0
        return pa.record_batch([pa.array(x, pa.int64()) for x in (zip(*rows, strict=True) if rows else ((),) * 4)], names=names)

    def take(group):
        few = len(group) <= FEW
        waiting[few][0].append(group)
        waiting[few][1][0] += sum(len(d) for _, _, d in group)
        return few if waiting[few][1][0] >= SORT_BLOCK else None

    group: list[tuple[int, int, bytes]] = []
    for batch in batches:
        for key, same, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if group and group[0][0] != key:
                if (full := take(group)) is not None:
                    yield solved(full)
                group = []
            group.append((key, same, data))
    if group:
        take(group)
    for few in (True, False):
        if waiting[few][0]:
            yield solved(few)


def _parted(block: int, batches: Iterator) -> Iterator:
    """The windows of stretches dealt by offset in blocks, each part keyed by the bytes that all windows of a block share."""
    import pyarrow as pa

    names = ["key", "same", "copies", "from_key", "from_same", "at", "more", "off", "data"]
    kinds = [pa.int64()] * 6 + [pa.int16()] * 2 + [pa.binary()]
    for batch in batches:
        rows = []
        for key, same, copies, more, off, data in zip(*(batch.column(k).to_pylist() for k in range(6)), strict=True):
            for b in range(max(0, off - more) // block, off // block + 1):
                first, last = max(0, off - (b + 1) * block + 1), min(more, off - b * block)
                core = data[off - b * block : off - (b + 1) * block + 1 + LENGTH]
                part = data[first : last + LENGTH]
                rows.append((_hash(b"%d %d " % (key, b) + core), _hash(part), copies, key, same, first, last - first, off - first, part))
        yield pa.record_batch([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True) if rows else ((),) * 9, kinds, strict=True)], names=names)


def _solve(parts: DataFrame, fetch, blocks: tuple[int, ...]) -> DataFrame:
    """(key, same, first, last) runs of the repeated windows of stretches.

    ``parts`` has a row (key, same, copies, more, off) for each different stretch, and whatever ``fetch`` needs to give its
    bytes. Written, for there are several readers.
    """
    by_key = parts.groupBy("key").agg(F.count("*").cast("int").alias("different"), F.min("copies").alias("fewest")).filter("different > 1 and fewest = 1")
    open_keys = written(by_key.select(F.col("key").alias("open_key"), "different"), "open-keys")
    opened = written(fetch(parts.join(small(open_keys), F.col("key") == F.col("open_key"))), "opened")
    few = opened.filter(F.col("different") <= MOST).select("key", "same", "data").repartition("key").sortWithinPartitions("key")
    whole = parts.filter("copies > 1").select("key", "same", F.lit(0).cast("long").alias("first"), F.col("more").cast("long").alias("last"))
    found = whole.unionByName(few.mapInArrow(_sorted_out, "key long, same long, first long, last long"))
    many = opened.filter(F.col("different") > MOST)
    links = inner = None
    if blocks and not many.isEmpty():
        dealt = many.select("key", "same", "copies", "more", "off", "data").mapInArrow(functools.partial(_parted, blocks[0]), "key long, same long, copies long, from_key long, from_same long, at long, more short, off short, data binary")
        links = written(dealt, "parted")
        # the parts of one key and hash have the same bytes
        each = links.groupBy("key", "same").agg(F.sum("copies").alias("copies"), F.first("more").alias("more"), F.first("off").alias("off"), F.first("data").alias("data"))
        inner = _solve(written(each, "parts"), lambda need: need.select("key", "same", "copies", "different", "more", "off", "data"), blocks[1:])
        up = links.select("key", "same", "from_key", "from_same", "at").join(inner, ["key", "same"])
        found = found.unionByName(up.select(F.col("from_key").alias("key"), F.col("from_same").alias("same"), (F.col("at") + F.col("first")).alias("first"), (F.col("at") + F.col("last")).alias("last")))
    out = written(found, "repeated")
    discard(open_keys, opened, parts, *(t for t in (links, inner) if t is not None))
    return out


def merged(batches: Iterator) -> Iterator:
    """(row, spans) with the maximal spans (begin, end) of each row, in order; those that touch are one.

    Batches have (row, list), where a span is begin * SPAN + its length.
    """
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        lists = batch.column(1)
        packed = lists.flatten().to_numpy()
        owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        order = np.lexsort((packed, owner))
        packed, owner = packed[order], owner[order]
        begin, length = packed // SPAN, packed % SPAN
        # rows one after the other on one line, so that the furthest end so far is never beyond a later row's begin
        base = owner * (int((begin + length).max(initial=0)) + 1)
        reach = np.maximum.accumulate(base + begin + length)
        heads = np.flatnonzero(np.append(True, (base + begin)[1:] > reach[:-1])[: len(packed)])
        tails = np.append(heads[1:], len(packed))[: len(heads)] - 1
        spans = pa.StructArray.from_arrays([pa.array(begin[heads]), pa.array((reach - base)[tails])], names=["a", "b"])
        many = np.bincount(owner[heads], minlength=len(lists))
        offsets = pa.array(np.append(0, np.cumsum(many)), pa.int32())
        yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(offsets, spans)], names=["row", "spans"])


def _rows(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(quoted(text_col)).cast("string").alias("text"))


def spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(row, spans) of the texts that have repeated bytes: arrays of the maximal (begin, end), in order."""
    rows = _rows(docs, text_col)
    every = written(rows.mapInArrow(_anchored, "row long, key long, same long, at long, more short, off short"), "stretches")
    twice = written(every.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"), "twice")
    some = written(every.join(small(twice), "key", "left_semi"), "some")
    discard(every, twice)
    first = F.min(F.struct("row", "at", "more", "off")).alias("first")
    parts = some.groupBy("key", "same").agg(F.count("*").alias("copies"), first)
    parts = written(parts.select("key", "same", "copies", F.col("first.row").alias("row"), F.col("first.at").alias("at"), F.col("first.more").alias("more"), F.col("first.off").alias("off")), "different")

    def fetch(need: DataFrame) -> DataFrame:
        wanted = need.groupBy("row").agg(F.collect_list(F.struct("key", "same", "copies", "different", "at", "more", "off")).alias("wanted"))
        texts = rows.join(wanted, "row").select("text", "wanted")
        return texts.mapInArrow(_cut_out, "key long, same long, copies long, different int, more short, off short, data binary")

    found = _solve(parts, fetch, BLOCKS)
    packed = (F.col("at") + F.col("first")) * SPAN + (F.col("last") - F.col("first") + LENGTH)
    where = some.select("row", "at", "key", "same").join(found, ["key", "same"]).select("row", packed.alias("span"))
    lists = where.groupBy("row").agg(F.collect_list("span").alias("spans"))
    out = written(lists.mapInArrow(merged, "row long, spans array<struct<a: long, b: long>>"), "spans")
    discard(some, found)
    return out


def _kept(whole: bool, batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        n_bytes, removed, n_spans, digests, texts = [], [], [], [], []
        for text, own in zip(batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
            data, at, kept = text.as_py() or b"", 0, []
            gone = [(s["a"], s["b"]) for s in own.as_py() or ()]
            for a, b in gone:
                kept.append(data[at:a])
                at = b
            kept.append(data[at:])
            n_bytes.append(len(data))
            removed.append(sum(b - a for a, b in gone))
            n_spans.append(len(gone))
            if whole:
                texts.append(b"".join(kept))
            else:
                digest = hashlib.sha256()
                for k in kept:
                    digest.update(k)
                digests.append(digest.hexdigest())
        arrays = [batch.column(0), *(pa.array(x, pa.int64()) for x in (n_bytes, removed, n_spans)), pa.array(texts, pa.binary()) if whole else pa.array(digests, pa.string())]
        yield pa.record_batch(arrays, names=["id", "n_bytes", "n_removed", "n_spans", "kept" if whole else "kept_sha256"])


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kept_bytes: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of each row of ``docs``; with ``kept_bytes`` the bytes themselves, ``kept``.

    Strings are judged on the texts as they are, UTF-8 or not, so a cut may fall inside a character. Null texts are empty;
    texts of less than LENGTH bytes keep all; equal texts of LENGTH bytes or more lose all; rows with null or repeated ids are
    judged one by one. An empty table gives none. Other columns are not read.

    ``docs`` is read several times and must have the same rows in the same order each time, as tables of files do; the result
    of a shuffle is to be written first.
    """
    found = spans(docs, text_col)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    kind, last = rows.schema["id"].dataType.simpleString(), "kept binary" if kept_bytes else "kept_sha256 string"
    out = rows.join(found, "row", "left").select("id", "text", "spans").mapInArrow(functools.partial(_kept, kept_bytes), f"id {kind}, n_bytes long, n_removed long, n_spans long, {last}")
    return reads(out, found)
