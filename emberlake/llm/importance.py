"""Importance resampling towards a target distribution of hashed word n-grams.

A text's features are its runs of one to three words; a feature's bucket is its CRC-32 modulo BUCKETS. A bucket's gain says
how much commoner it is in the target than in the corpus, a text's weight is the sum of its gains, and texts are drawn by
weight plus Gumbel noise.

CRC-32 is linear: the state of "a b" is that of "a" moved on by the length of " b", xor that of " b". So a run's state comes
from the states of its words, by table look-ups in numpy, and no feature is ever spelt out. Words are looked up in a head
vocabulary, the HEAD_WORDS most frequent of the corpus with their states, which is broadcast; the states of other words
are taken from their bytes. Frequent pairs have their states and buckets in a second broadcast table of fixed size, other
pairs are moved on from their first word. Head and tail give the same states, so bucket totals and weights are exact
whatever is in the head.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlake.llm.common import discard, quoted, reads, written
from emberlake.operators import ranges

BUCKETS = 10_000
LONGEST = 3
SEED = 42
PERCENT, LEAST_WORDS = 5, 20
#: Sizes of the broadcast tables, whatever the corpus.
HEAD_WORDS = 65_536
HEAD_PAIRS = 65_536
PAIR_SLOTS = 1 << 18
#: A pair's code is the number of its first word times this, plus that of its second; no number reaches it.
BASE = 1 << 24
#: Words whose features are made at once, and words (other than the head's) that a task keeps: both bound memory.
BLOCK_WORDS = 1 << 17
KEPT_WORDS = 300_000
#: Bytes of a text that are cut into words at once.
BLOCK_BYTES = 1 << 20
#: Of each block so many of its most frequent pairs are counted; that choice moves no result.
BLOCK_PAIRS = 1_024
#: Letters a-z and digits stay, A-Z are lowered, bytes beyond ASCII stay, all others part words.
_WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def pieces(text: bytes | None) -> Iterator[list[bytes]]:
    """The words of a UTF-8 text (null: none), a block at a time; bytes that are not UTF-8 count as U+FFFD."""
    text = text or b""
    try:
        text.decode()
    except UnicodeDecodeError:
        text = text.decode("utf-8", "replace").encode()
    begin, size = 0, BLOCK_BYTES
    while begin + size < len(text):
        block = text[begin : begin + size].translate(_WORD_BYTES)
        if (cut := block.rfind(b" ")) <= 0:  # a word longer than the block
            size *= 2
            continue
        yield block[:cut].split()
        begin, size = begin + cut, BLOCK_BYTES
    yield text[begin:].translate(_WORD_BYTES).split()


@functools.cache
def _moves():
    """CRC-32 states moved on by zero bytes: tables [n][byte of the state][its value] for n below 64, and for 64, 128, ..."""
    import numpy as np

    step = np.array([zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0") for b in range(256)], np.uint32)  # of a state's low byte
    one = lambda s: step[s & 255] ^ (s >> 8)
    at = lambda t, s: t[0][s & 255] ^ t[1][s >> 8 & 255] ^ t[2][s >> 16 & 255] ^ t[3][s >> 24]
    near = [np.array([[b << 8 * j for b in range(256)] for j in range(4)], np.uint32)]
    while len(near) < 65:
        near.append(one(near[-1]))
    far = [near.pop()]
    while len(far) < 26:
        far.append(at(far[-1], far[-1]))
    return np.stack(near).reshape(-1), far


def moved(states, lengths):
    """CRC-32 ``states`` moved on by ``lengths`` zero bytes each: xor the CRC-32 of as many bytes, it is that of the whole."""
    import numpy as np

    near, far = _moves()
    base = (lengths & 63) << 10
    out = near[base + (states & 255)] ^ near[base + 256 + (states >> 8 & 255)] ^ near[base + 512 + (states >> 16 & 255)] ^ near[base + 768 + (states >> 24)]
    for k in range(6, int(lengths.max(initial=0)).bit_length()):
        t, which = far[k - 6], np.flatnonzero(lengths >> k & 1)
        s = out[which]
        out[which] = t[0][s & 255] ^ t[1][s >> 8 & 255] ^ t[2][s >> 16 & 255] ^ t[3][s >> 24]
    return out


class Words(dict):
    """Numbers of words. The head's come first; a word that isn't there gets the next number and the state of its bytes."""

    def __init__(self, head: list[bytes]):
        super().__init__()
        self.clear()
        self.head = head
        self.tail: list[bytes] = []
        self.states = self.spaced = self.lengths = None
        self.update(zip(head, range(len(head)), strict=True))
        self._grow(head)

    def _grow(self, words: list[bytes]) -> None:
        import numpy as np

        made = [np.fromiter(map(zlib.crc32, words), np.uint32, len(words)), np.fromiter((zlib.crc32(b" " + w) for w in words), np.uint32, len(words)), np.fromiter(map(len, words), np.int64, len(words)) + 1]
        if self.states is not None:
            made = [np.concatenate(both) for both in zip((self.states, self.spaced, self.lengths), made, strict=True)]
        self.states, self.spaced, self.lengths = made

    def __missing__(self, word: bytes) -> int:
        self[word] = at = len(self)
        self.tail.append(word)
        return at

    def numbers(self, words: list[bytes]):
        import numpy as np

        if len(self) > len(self.head) + KEPT_WORDS:
            self.__init__(self.head)
        found = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.tail:
            self._grow(self.tail)
            self.tail = []
        return found


class Pairs:
    """States and buckets of the head's pairs in a table of PAIR_SLOTS; of two pairs of one slot the more frequent stays."""

    def __init__(self, codes):
        import numpy as np

        self.codes = np.full(PAIR_SLOTS, -1, np.int64)
        codes = np.asarray(codes, np.int64)[::-1]  # the first is written last
        self.codes[self.slots(codes)] = codes
        self.states = self.buckets = None

    @staticmethod
    def slots(codes):
        import numpy as np

        return (codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - (PAIR_SLOTS - 1).bit_length())).astype(np.int64)

    def fill(self, words: Words) -> None:
        """The states of the pairs, from their words'."""
        import numpy as np

        a, b = np.divmod(np.maximum(self.codes, 0), BASE)
        if not len(words.head):
            a = b = np.zeros(0, np.int64)
            self.codes = self.codes[:0]
        self.states = moved(words.states[a], words.lengths[b]) ^ words.spaced[b]
        self.buckets = (self.states % np.uint32(BUCKETS)).astype(np.int64)


class Features:
    """Buckets of all features of a stream of words; ``pairs`` may be none."""

    def __init__(self, head: list[bytes], pair_codes=None):
        self.words = Words(head)
        self.pairs = None
        if pair_codes is not None and len(head):
            self.pairs = Pairs(pair_codes)
            self.pairs.fill(self.words)

    def buckets(self, numbers, rows, carried: int):
        """Buckets and rows of the features that end after the first ``carried`` words; features stay in a row."""
        import numpy as np

        words, n = self.words, np.uint32(BUCKETS)
        state, spaced, length = words.states[numbers], words.spaced[numbers], words.lengths[numbers]
        out = [((state[carried:] % n).astype(np.int64), rows[carried:])]
        two, bucket = np.zeros(max(0, len(numbers) - 1), np.uint32), np.zeros(max(0, len(numbers) - 1), np.int64)
        rest = np.ones(len(two), bool)
        if self.pairs is not None:
            n_head = len(words.head)
            able = np.flatnonzero((numbers[:-1] < n_head) & (numbers[1:] < n_head))
            codes = numbers[able] * BASE + numbers[able + 1]
            slots = self.pairs.slots(codes)
            hit = self.pairs.codes[slots] == codes
            able, slots = able[hit], slots[hit]
            two[able], bucket[able], rest[able] = self.pairs.states[slots], self.pairs.buckets[slots], False
        tail = np.flatnonzero(rest)
        two[tail] = moved(state[tail], length[tail + 1]) ^ spaced[tail + 1]
        bucket[tail] = two[tail] % n
        from_two = max(0, carried - 1)
        same = np.flatnonzero(rows[from_two:-1] == rows[from_two + 1 :]) + from_two
        out.append((bucket[same], rows[same]))
        from_three = max(0, carried - 2)
        same = np.flatnonzero(rows[from_three:-2] == rows[from_three + 2 :]) + from_three
        three = moved(two[same], length[same + 2]) ^ spaced[same + 2]
        out.append(((three % n).astype(np.int64), rows[same]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def of(self, texts, n_words: list[int]) -> Iterator:
        """(buckets, row numbers) of the features of all texts, in blocks; appends each text's number of words."""
        import numpy as np

        flat: list[bytes] = []
        rows: list[tuple[int, int]] = []
        carried = 0  # the last two words of the block before begin the next one

        def block():
            nonlocal flat, rows, carried
            owner = np.repeat(np.array([r for r, _ in rows], np.int64), np.array([k for _, k in rows], np.int64))
            found = self.buckets(self.words.numbers(flat), owner, carried)
            carried = min(2, len(flat))
            flat, rows = flat[-2:], [(r, 1) for r in owner[-2:].tolist()]
            return found

        for row, text in enumerate(texts):
            n_words.append(0)
            for words in pieces(text):
                flat += words
                rows.append((row, len(words)))
                n_words[row] += len(words)
                if len(flat) >= BLOCK_WORDS:
                    yield block()
        if len(flat) > carried:
            yield block()


def _texts(batch, k: int = 0) -> Iterator[bytes | None]:
    import pyarrow as pa

    return (t.as_py() for t in batch.column(k).cast(pa.binary()))


def _counted(batches: Iterator) -> Iterator:
    """Counts of words (second null), and of each block's most frequent pairs."""
    import numpy as np
    import pyarrow as pa

    kept: Counter[bytes] = Counter()
    block: list[bytes] = []
    parts: list[int] = []  # where another row begins

    def out(rows):
        first, second, n = zip(*rows, strict=True) if rows else ((), (), ())
        return pa.record_batch([pa.array(first, pa.binary()), pa.array(second, pa.binary()), pa.array(n, pa.int64())], names=["first", "second", "n"])

    def pairs():
        number: dict[bytes, int] = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in block), np.int64, len(block))
        inside = np.ones(max(0, len(ids) - 1), bool)
        inside[[p - 1 for p in parts if 0 < p < len(ids)]] = False
        codes, n = np.unique((ids[:-1] << 32 | ids[1:])[inside], return_counts=True)
        best = np.argsort(-n, kind="stable")[:BLOCK_PAIRS]
        spelt = list(number)
        return [(spelt[c >> 32], spelt[c & 0xFFFFFFFF], k) for c, k in zip(codes[best].tolist(), n[best].tolist(), strict=True) if k > 1]

    for batch in batches:
        for text in _texts(batch):
            parts.append(len(block))
            for words in pieces(text):
                kept.update(words)
                block += words
                if len(block) >= BLOCK_WORDS:
                    yield out(pairs())
                    block, parts = [], []
                if len(kept) >= KEPT_WORDS:
                    yield out([(w, None, n) for w, n in kept.items()])
                    kept = Counter()
    yield out(pairs())
    yield out([(w, None, n) for w, n in kept.items()])


def head(docs: DataFrame, text_col: str = "text") -> tuple[list[bytes], list[int]]:
    """The most frequent words of all texts, HEAD_WORDS at most, and codes of HEAD_PAIRS at most of the pairs that were counted.

    A histogram of the counts (classes of an eighth of a power of two) gives the least class that still fits whole, so that
    no more rows than these come to the driver, from however many tasks.
    """
    rows = docs.select(F.col(quoted(text_col)).cast("string").alias("text"))
    counts = written(rows.mapInArrow(_counted, "first binary, second binary, n long").groupBy("first", "second").agg(F.sum("n").alias("n")), "head-counts")
    size = F.floor(8 * F.log2("n")).cast("int")
    classes = counts.groupBy(F.col("second").isNull().alias("single"), size.alias("size")).agg(F.count("*").alias("rows")).collect()

    def most(single: bool, bound: int) -> list:
        least, rows = 1 << 30, 0
        for r in sorted((r for r in classes if r["single"] == single), key=lambda r: -r["size"]):
            if (rows := rows + r["rows"]) > bound:
                break
            least = r["size"]
        found = counts.filter((F.col("second").isNull() == single) & (size >= least)).collect()
        return sorted(found, key=lambda r: (-r["n"], bytes(r["first"]), bytes(r["second"] or b"")))

    words = [bytes(r["first"]) for r in most(True, HEAD_WORDS)]
    number = {w: k for k, w in enumerate(words)}
    both = [(number.get(bytes(r["first"])), number.get(bytes(r["second"]))) for r in most(False, HEAD_PAIRS)]
    discard(counts)
    return words, [a * BASE + b for a, b in both if a is not None and b is not None]


def _totals(tables, batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    features, total = Features(*tables.value), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for buckets, _ in features.of(_texts(batch), []):
            total += np.bincount(buckets, minlength=BUCKETS)
    there = np.flatnonzero(total)
    yield pa.record_batch([pa.array(there.astype(np.int32)), pa.array(total[there])], names=["bucket", "n"])


def totals(docs: DataFrame, tables, text_col: str = "text") -> list[int]:
    """How many features of all texts fall into each bucket; each task sends BUCKETS sums at most."""
    rows = docs.select(F.col(quoted(text_col)).cast("string").alias("text"))
    found = rows.mapInArrow(functools.partial(_totals, tables), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = [0] * BUCKETS
    for r in found.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    """floor(1000 ln) of the ratio of smoothed shares, bucket by bucket."""
    whole, aimed = float(sum(corpus) + BUCKETS), float(sum(target) + BUCKETS)
    return [math.floor(1000 * math.log((t + 1.0) * whole / ((s + 1.0) * aimed))) for s, t in zip(corpus, target, strict=True)]


def _weighed(tables, gain, batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa

    features, gain = Features(*tables.value), np.array(gain.value, np.float64)
    for batch in batches:
        n_words: list[int] = []
        weight = np.zeros(batch.num_rows)  # sums of integers: exact in doubles
        for buckets, rows in features.of(_texts(batch, 1), n_words):
            weight += np.bincount(rows, gain[buckets], minlength=batch.num_rows)
        n = np.array(n_words, np.int64)
        n_features = sum(np.maximum(n - k, 0) for k in range(LONGEST))
        yield pa.record_batch([batch.column(0), pa.array(n), pa.array(n_features), pa.array(weight.astype(np.int64))], names=["id", "n_words", "n_features", "weight"])


def weigh(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """(id, n_words, n_features, weight) of each row of ``docs``, the weight towards the texts of ``target``.

    Null and empty texts have no features and weight 0; rows with null or repeated ids are weighed one by one; all texts of
    both tables count, whole. An empty table of documents gives none; of an empty target all shares are equal.
    """
    context = docs.sparkSession.sparkContext
    tables = context.broadcast(head(docs, text_col))
    gain = context.broadcast(gains(totals(docs, tables, text_col), totals(target, tables, target_col)))
    rows = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).cast("string").alias("text"))
    return rows.mapInArrow(functools.partial(_weighed, tables, gain), f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def gumbel(id_: Column, seed: int = SEED) -> Column:
    """1000 times Gumbel noise, rounded down, by a hash of seed and id (null as the empty text)."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, **columns: str) -> DataFrame:
    """Every row of ``docs`` as (id, n_words, n_features, weight, score, rank): ``rank`` counts the drawn ones, null for the others.

    Drawn are ``percent`` of a hundred (rounded down) of the texts of ``least_words`` words or more, by the highest score;
    ties go to the smaller id, null first, and among rows of one id and score any come first. Ranks are places in ranges
    of the score, so no task ranks more than a range.
    """
    scored = weigh(docs, target, **columns)
    scored = written(scored.withColumn("score", F.col("weight") + gumbel(F.col("id"), seed)), "scored")
    able = ranges.placed(scored.filter(F.col("n_words") >= least_words), [("score", False), ("id", True)])
    draw = scored.filter(F.col("n_words") >= least_words).count() * percent // 100
    ranked = able.withColumn("rank", F.when(F.col("place") < draw, F.col("place") + 1).cast("long")).drop("place")
    return reads(ranked.unionByName(scored.filter(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))), scored, able)


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of ``docs`` whose id was drawn, all their columns; null ids are never taken."""
    taken = resample(docs, target, id_col=id_col, **options).filter("rank is not null and id is not null").select(F.col("id").alias("__drawn")).distinct()
    return docs.join(taken, docs[quoted(id_col)] == taken["__drawn"], "left_semi")
