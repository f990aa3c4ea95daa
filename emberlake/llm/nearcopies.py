"""Near copies of documents: texts whose sets of five-word shingles have a Jaccard coefficient of 0.8 or more.

Candidates come from SimHash balls (``simhash``, over the same shingles) and, as texts at 0.8 mostly lie beyond any ball
that can be emitted, from bands of least hashes. All of them are compared by their shingles, and only matches are linked.

Every text has 100 least hashes in 20 bands of five; two texts at 0.8 share a band with a probability of 0.9996. A pair
of a band's key is settled once it was compared or its texts are in one group anyway. So each round compares a few pairs
and then takes the groups of all matches so far; keys whose members are all in one group are done. Keys of up to ALL_PAIRS
members have all their pairs compared that lie in different groups. In larger keys others are compared with two hubs: first
a random one of each key, then the member of most links: whichever copies of one text were drawn first, all are linked to
that text, so it is the next hub. Then large keys that are still open are dealt anew, under SUB_KEYS keys of five more hashes
each, as long as that halves their open pairs: members that are mostly unlike fall apart. Where they don't, or open pairs are
few beside the texts, all open pairs are compared in blocks of members (``_matches_in_blocks``), and that is the end: pairs are
no rows there, a task holds two blocks, and rows grow with members and the blocks of their key. No link is given up.

Equal texts are found by their digests before any of this, so a text is sketched once however often it comes. Texts are
picked out by bitmaps of their row keys (``_among``), one bit for each row of the input, and are not shuffled for it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from itertools import repeat

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberlake.llm import simhash
from emberlake.llm.common import discard, let, quoted, reads, written
from emberlake.llm.components import component_labels

SHINGLE_WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 20, 5
#: Keys of so many members at most have all pairs compared; in the first round, of so many.
ALL_PAIRS, FIRST_PAIRS = 32, 16
SUB_KEYS = 8
#: All pairs of all open keys, of members in different groups, are compared when they are this many for each different text at most.
PAIRS_A_TEXT = 4
#: Keys that are large and open after so many deals hold texts of equal sketches that are unlike: all pairs are compared.
DEEPEST = 10
#: Members of a key that are compared with as many others by one task.
BLOCK_MEMBERS = 128
#: Least hashes that two texts have in common to be compared: at 0.8 fewer have a probability of 1e-9.
LEAST_COMMON = 55
SEED = 42
#: Shingles hashed at once: their hashes, BANDS * BAND_ROWS for each, stay in a core's cache.
BLOCK = 512
#: So many bitmaps of 32,768 row keys are broadcast, 4 KB each; rows are joined by a shuffle beyond.
BITMAPS = 4096


def shingles(text: bytes) -> set[bytes]:
    """The different word shingles of a UTF-8 text; a shorter text is one shingle."""
    found = text.lower().split()  # bytes: A-Z only, and the six ASCII spaces
    if len(found) <= SHINGLE_WORDS:
        return {b" ".join(found)}
    return set(map(b" ".join, zip(*(found[k:] for k in range(SHINGLE_WORDS)), strict=False)))


@functools.cache
def _multipliers():
    import numpy as np

    rng = np.random.default_rng(SEED)
    draw = lambda: rng.integers(1, 1 << 64, BANDS * BAND_ROWS, np.uint64)
    return (draw() | np.uint64(1))[:, None], draw()[:, None]


def hashes_of(text: bytes):
    """The 64-bit hashes of a text's different shingles."""
    import numpy as np
    import xxhash

    found = shingles(text)
    return np.fromiter(map(xxhash.xxh64_intdigest, found, repeat(SEED)), "<u8", len(found))


def sketch(text: bytes):
    """The number of different shingles, the SimHash over them, and the least of each of BANDS * BAND_ROWS hashes of them, 32 bits each."""
    import numpy as np

    times, plus = _multipliers()
    hashes = hashes_of(text)
    least, counts = np.full(BANDS * BAND_ROWS, 0xFFFFFFFFFFFFFFFF, np.uint64), np.zeros(simhash.BITS, np.int64)
    for k in range(0, len(hashes), simhash.BLOCK):
        counts += simhash.bit_counts(hashes[k : k + simhash.BLOCK])
    room = np.empty((BANDS * BAND_ROWS, min(BLOCK, len(hashes))), np.uint64)
    for k in range(0, len(hashes), BLOCK):
        part = hashes[k : k + BLOCK]
        mixed = np.multiply(part, times, out=room[:, : len(part)])
        mixed += plus
        np.minimum(least, mixed.min(axis=1), out=least)
    fp = simhash.majority(counts, len(hashes))
    return len(hashes), (fp ^ 1 << 63) - (1 << 63), (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _sketches(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        texts = [t.as_py() or b"" for t in batch.column(1).cast(pa.binary())]
        sizes, prints, found = zip(*map(sketch, texts), strict=True) if texts else ((), (), ())
        arrays = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(prints, pa.int64()), pa.array(found, pa.list_(pa.int32()))]
        yield pa.record_batch(arrays, names=["row", "size", "fp", "sketch"])


def _among(rows: DataFrame, row: str, keys: DataFrame, others: bool = False) -> DataFrame:
    """The rows whose key (column ``row``) is in ``keys`` (row), or with ``others`` those whose key is not.

    ``keys`` are made to bitmaps, which are written and broadcast, so that rows stay where they are: a bit for each row,
    whatever share of them is asked for. Who discards the result discards ``keys`` with them.
    """
    by_bit = keys.groupBy(F.bitmap_bucket_number("row").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("row")).alias("bits"))
    bits = written(by_bit, "bitmaps")
    if bits.count() > BITMAPS:
        discard(bits)
        own = rows.join(keys.select(F.col("row").alias(row)), row, "left_anti" if others else "left_semi")
        return reads(own.select(*(quoted(c) for c in rows.columns)), keys)
    at = F.bitmap_bit_position(row)
    byte = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    there = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) > 0, F.lit(False))
    found = rows.join(F.broadcast(bits), F.bitmap_bucket_number(row) == F.col("bucket"), "left").filter(~there if others else there)
    return reads(found.select(*(quoted(c) for c in rows.columns)), bits, keys)


def _sets(batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        found = [np.unique(hashes_of(t.as_py() or b"")).view(np.int64) for t in batch.column(1).cast(pa.binary())]
        yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["row", "hashes"])


def _sets_of(rows: DataFrame, keys: DataFrame, tag: str) -> DataFrame:
    """(row, hashes) of the texts whose row keys are in ``keys``: the hashes of their different shingles, made once a text; written."""
    found = _among(rows, "row", keys)
    out = written(found.mapInArrow(_sets, "row long, hashes array<long>"), tag)
    discard(found)
    return out


def _matches(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """Of the pairs (a, b) of row keys those whose texts are near copies.

    Pairs of sets too different in size, or with too few least hashes in common, go first, so only texts that are alike are moved.
    """
    of = lambda key, sketch, size: nodes.select(F.col("node").alias(key), F.col("sketch").alias(sketch), F.col("size").alias(size))
    sketched = pairs.join(of("a", "x", "m"), "a").join(of("b", "y", "n"), "b").filter(F.least("m", "n") >= similarity * F.greatest("m", "n"))
    common = F.aggregate(F.zip_with("x", "y", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, one: n + one)
    alike = written(sketched.filter(common >= LEAST_COMMON).select("a", "b"), "alike")
    paired = written(alike.select(F.explode(F.array("a", "b")).alias("row")).distinct(), "paired")
    sets = _sets_of(rows, paired, "compared")
    both = alike.join(sets.select(F.col("row").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("row").alias("b"), F.col("hashes").alias("y")), "b")
    near = let(F.size(F.array_intersect("x", "y")), lambda n: n >= similarity * (F.size("x") + F.size("y") - n))
    found = written(both.filter(near).select("a", "b"), "matches")
    discard(alike, sets)
    return found


def _compared(similarity: float, table):
    """The near copies (a, b) among the members of one block, or between those of two, that are in different groups."""
    import numpy as np
    import pyarrow as pa

    one, other = table["low"][0].as_py(), table["high"][0].as_py()
    block, node, label, size = (table[c].to_numpy() for c in ("block", "node", "label", "size"))
    sketches = np.stack(table["sketch"].to_numpy())
    sets, links, label = table["hashes"], [], label.copy()
    held = functools.cache(lambda k: set(sets[k].as_py()))
    for x in np.flatnonzero(block == one).tolist():
        rest = np.flatnonzero((block == other) & (label != label[x]) & (np.minimum(size, size[x]) >= similarity * np.maximum(size, size[x])) & ((node > node[x]) | (one != other)))
        rest = rest[(sketches[rest] == sketches[x]).sum(axis=1) >= LEAST_COMMON]
        for y in rest.tolist():
            if label[x] != label[y]:  # a link found here brings whole groups together
                both = len(held(x) & held(y))
                if both >= similarity * (len(held(x)) + len(held(y)) - both):
                    links.append((node[x], node[y]))
                    label[label == label[y]] = label[x]
    a, b = zip(*links, strict=True) if links else ((), ())
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _matches_in_blocks(rows: DataFrame, nodes: DataFrame, opened: DataFrame, similarity: float) -> DataFrame:
    """Of all pairs of members (key, n, node, label) of one key, in different groups, enough near copies to link all that are.

    The members of a key are dealt to blocks of BLOCK_MEMBERS or so, and each two blocks meet in one group of rows. A
    member's row is made once for each block of its key.
    """
    wanted = written(opened.select(F.col("node").alias("row")).distinct(), "open-rows")
    sets = _sets_of(rows, wanted, "open-sets")
    blocks = F.ceil(F.col("n") / BLOCK_MEMBERS)
    dealt = opened.withColumns({"blocks": blocks, "block": F.pmod(F.xxhash64("node", "key"), blocks)}).withColumn("met", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    whole = dealt.join(nodes, "node").join(sets.select(F.col("row").alias("node"), "hashes"), "node")
    shown = whole.select("key", F.least("block", "met").alias("low"), F.greatest("block", "met").alias("high"), "block", "node", "label", "size", "sketch", "hashes")
    found = written(shown.groupBy("key", "low", "high").applyInArrow(functools.partial(_compared, similarity), "a long, b long").distinct(), "matches")
    discard(sets)
    return found


def _open_pairs(members: DataFrame) -> int:
    """How many pairs of members (key, node, label) of one key are in different groups."""
    each = members.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key").agg(F.sum("n").alias("m"), F.sum(F.expr("n * n")).alias("q"))
    return each.agg(F.sum(F.expr("(m * m - q) div 2"))).first()[0] or 0


def ball_pairs(prints: DataFrame, radius: int = 2) -> DataFrame:
    """Candidates (a, b) of row keys whose fingerprints lie in one ball; ``prints`` has (row, fp) of different texts.

    Texts with one fingerprint meet the least of them, and the least of each fingerprint that of the ball's hub.
    """
    first = written(prints.groupBy("fp").agg(F.min("row").alias("first")), "firsts")
    inside = prints.join(first, "fp").filter("row != first").select(F.col("row").alias("a"), F.col("first").alias("b"))
    ball = simhash.ball_links(first, radius)
    ball = ball.join(first.select(F.col("fp").alias("a"), F.col("first").alias("x")), "a").join(first.select(F.col("fp").alias("b"), F.col("first").alias("y")), "b")
    pairs = written(inside.unionByName(ball.select(F.col("x").alias("a"), F.col("y").alias("b"))).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "ball-pairs")
    discard(first)
    return pairs


def _ordered(a: str, b: str) -> list:
    return [F.greatest(a, b).alias("a"), F.least(a, b).alias("b")]


def _all_pairs(members: DataFrame) -> DataFrame:
    """Pairs of members of one key that are in different groups; for keys of bounded size."""
    one, other = (members.select("key", F.col("node").alias(n), F.col("label").alias(f"{n}_label")) for n in ("a", "b"))
    return one.join(other, "key").filter("a > b and a_label != b_label").select("a", "b")


def _counted(members: DataFrame) -> DataFrame:
    """Members (key, node) of keys that have more than one, with their number ``n``."""
    n = written(members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "key-sizes")
    out = written(members.join(n, "key").select("key", "n", "node"), "members")
    discard(n)
    return out


def _hub_pairs(opened: DataFrame, degrees: DataFrame, number: int) -> DataFrame:
    """Two hubs of each key with all its members of other groups: the member of most links so far, and one drawn anew."""
    draw = F.xxhash64("node", "key", F.lit(number))
    linked = opened.join(degrees, "node", "left").withColumns({"degree": F.coalesce("degree", F.lit(0)), "draw": draw})
    one = lambda first: F.max(F.struct(first, "draw", F.col("node").alias("hub"), F.col("label").alias("hub_label")))
    hubs = linked.groupBy("key").agg(F.array(one(F.col("degree")), one(F.col("draw").alias("degree"))).alias("hubs"))
    hubs = hubs.select("key", F.explode("hubs").alias("h")).select("key", "h.hub", "h.hub_label").distinct()
    return opened.join(hubs, (opened["key"] == hubs["key"]) & (opened["label"] != hubs["hub_label"])).select(*_ordered("node", "hub"))


def _dealt_anew(large: DataFrame, nodes: DataFrame, depth: int) -> DataFrame:
    """The members of each key under SUB_KEYS keys of five more hashes; where these begin depends on the key."""
    each = large.select("key", "node").join(nodes, "node").withColumn("sub", F.explode(F.sequence(F.lit(0), F.lit(SUB_KEYS - 1))))
    begin = F.pmod(F.xxhash64("key", "sub", F.lit(depth)), F.lit(BANDS * BAND_ROWS)).cast("int") + 1
    return each.select(F.xxhash64("key", "sub", F.slice(F.concat("sketch", "sketch"), begin, F.lit(BAND_ROWS))).alias("key"), "node").distinct()


def groups_of(rows: DataFrame, different: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(node, label) of the row keys that have near copies; ``rows`` has (row, text), ``different`` (row, size, fp, sketch) of different texts.

    ``label`` is the least row key that is reachable by links. The result is written; the caller discards it.
    """
    nodes = different.select(F.col("row").alias("node"), "size", "sketch")
    bands = nodes.select("node", "sketch", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    members = _counted(bands.select(F.xxhash64("band", F.slice("sketch", F.col("band") * BAND_ROWS + 1, F.lit(BAND_ROWS))).alias("key"), "node"))
    balls, n_texts = ball_pairs(different.select("row", "fp")), different.count()
    # in the first round each text is a group of its own; small keys are settled by it
    still = members.filter(F.col("n") > FIRST_PAIRS)
    hub = F.min(F.struct(F.xxhash64("node", "key").alias("draw"), F.col("node").alias("hub"))).alias("first")
    hubs = still.groupBy("key").agg(hub).select("key", F.col("first.hub").alias("hub"))
    pairs = _all_pairs(members.filter(F.col("n") <= FIRST_PAIRS).withColumn("label", F.col("node")))
    pairs = pairs.unionByName(still.join(hubs, "key").filter("node != hub").select(*_ordered("node", "hub"))).unionByName(balls)
    done, number, labels, links = [members, balls], 0, None, []

    def joined(found: DataFrame) -> DataFrame:
        # groups so far are stars already, so few steps join them by the new links
        out = component_labels(found if labels is None else found.unionByName(labels.select(F.col("node").alias("a"), F.col("label").alias("b"))))
        links.append(found)
        discard(*([] if labels is None else [labels]))
        return out

    while True:
        fresh = written(pairs.distinct(), "pairs")
        labels = joined(_matches(rows, nodes, fresh, similarity))
        discard(fresh)
        grouped = written(still.join(labels, still["node"] == labels["node"], "left").select("key", "n", still["node"], F.coalesce("label", still["node"]).alias("label")), "grouped")
        apart = written(grouped.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high").select("key"), "apart")
        opened = written(grouped.join(apart, "key", "left_semi"), "open-members")
        discard(*done, grouped, apart)
        if opened.isEmpty():
            discard(opened, *links)
            return labels
        number += 1
        small_keys, large = opened.filter(F.col("n") <= ALL_PAIRS), opened.filter(F.col("n") > ALL_PAIRS)
        degrees = functools.reduce(DataFrame.unionByName, links).select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("degree"))
        if number == 1:  # the copies of one text mostly end here
            pairs, still, done = _hub_pairs(opened, degrees, number), opened.select("key", "n", "node"), [opened]
            continue
        anew, now = None, _open_pairs(opened)
        if number <= DEEPEST and now > PAIRS_A_TEXT * n_texts:
            anew = _counted(_dealt_anew(large, nodes, number))
            if 2 * _open_pairs(anew.join(large.select("node", "label").distinct(), "node")) > _open_pairs(large):
                discard(anew)  # texts that are alike but not near: more keys would hold them again, many times over
                anew = None
        if anew is None:
            labels = joined(_matches_in_blocks(rows, nodes, opened, similarity))
            discard(opened, *links)
            return labels
        pairs, still, done = _all_pairs(small_keys).unionByName(_hub_pairs(large, degrees, number)), anew, [opened, anew]


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without near copies: of each group linked by near copies, one row stays.

    It is the row of the least id, null ids last; of rows with one id any one, told apart by a row key. Null texts count
    as empty ones, and blank texts as copies of each other. All columns of ``docs`` are returned unchanged, whatever their
    names but ``__row``. An empty table gives an empty one.
    """
    whole = written(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    rows = whole.select(F.col("__row").alias("row"), F.col(quoted(text_col)).cast("string").alias("text"))
    own_id, digest = F.col(quoted(id_col)), F.unhex(F.md5(F.coalesce(F.col(quoted(text_col)).cast("string"), F.lit("")).cast("binary")))
    order = F.struct(own_id.isNull().alias("none"), own_id.alias("id"), F.col("__row").alias("row")).alias("order")
    made = written(whole.select(F.col("__row").alias("row"), digest.alias("same"), order), "digests")
    # equal texts: the least row stands for them
    least = written(made.groupBy("same").agg(F.min("row").alias("row")), "least")
    chosen = _among(rows, "row", least.select("row"))
    different = written(chosen.mapInArrow(_sketches, "row long, size long, fp long, sketch array<int>"), "sketches")
    discard(chosen)
    labels = groups_of(rows, different, similarity)
    groups = written(least.join(labels, F.col("row") == F.col("node"), "left").select("same", F.coalesce("label", "row").alias("group")), "groups")
    placed = written(made.join(groups, "same").select("group", "row", "order"), "placed")
    first = written(placed.groupBy("group").agg(F.min("order").alias("first")).select("group", F.col("first.row").alias("first")), "first")
    gone = written(placed.join(first, "group").filter("row != first").select("row"), "gone")
    discard(made, least, different, labels, groups, placed, first)
    kept = _among(whole, "__row", gone, others=True)
    return reads(kept.drop("__row"), whole, kept)
