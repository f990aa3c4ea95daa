"""Training-order materialisation of token ids in fixed-stride shards.

All texts make one stream of token ids (two bytes each), an end after each text, in the order of the input's files and
rows or of columns that the caller names; every ``length`` ids of it are a sequence. The stream's places come from sums
over its runs (a run: the rows of one split, or one range), so neither tasks nor cluster size change a sequence.

A keyed Feistel permutation over the next power of four, walked until it falls below the number of sequences, turns a
sequence's number into its slot: the training order. A shard is a range of slots, and a partition holds a range of shards,
sorted by slot, so record k of a shard lies at k * stride. Only the parts of sequences are shuffled, once.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emberlake.llm.common import partitions, small, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Ends a text and fills the last sequence of all; free in the vocabulary.
END = 50256
LENGTH = 2048
SHARD_RECORDS = 2048
#: Shards of a partition at most: it is sorted by one task.
PARTITION_SHARDS = 32
KEY = 0x5EED
ROUNDS = 6
#: Ids of a stored portion of the stream, and characters that are tokenised at once: both bound memory.
PORTION = 1 << 18
TEXT_CHARS = 1 << 20
#: A text may be cut before a single space between two words: no token of the pattern reaches across.
_CUT = re.compile(r"(?<=\S) (?=\S)")


@functools.cache
def tokenizer(vocabulary: str):
    import base64

    import public_tokenizers
    import tiktoken

    with open(vocabulary, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _parts(text: str, most: int = TEXT_CHARS) -> Iterator[str]:
    """A text in parts of about ``most`` characters that are tokenised as the whole is."""
    begin = 0
    while len(text) - begin > most and (cut := _CUT.search(text, begin + most)):
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


def packed(ids, level: int = 3) -> bytes:
    import numpy as np
    import zstandard

    return zstandard.ZstdCompressor(level=level, write_content_size=True, write_checksum=False).compress(np.ascontiguousarray(ids, "<u2").tobytes())


def unpacked(data: bytes):
    import numpy as np
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<u2")


def _stream(vocabulary: str, portion: int, batches: Iterator) -> Iterator:
    """Portions (file, block, at, n, ids) of the ids of each run of rows; ``at`` counts from the run's start."""
    import numpy as np
    import pyarrow as pa

    encode, run, at, held, n_held = tokenizer(vocabulary).encode_ordinary, None, 0, [], 0

    def out():
        flat = np.concatenate(held)
        arrays = [pa.array([run[0]], pa.string()), pa.array([run[1]], pa.int64()), pa.array([at], pa.int64()), pa.array([len(flat)], pa.int32()), pa.array([packed(flat, 6)], pa.binary())]
        return pa.record_batch(arrays, names=["file", "block", "at", "n", "ids"])

    for batch in batches:
        files, blocks = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        for text, *own in zip(batch.column(0).cast(pa.binary()), files, blocks, strict=True):
            if own != run:
                if held:
                    yield out()
                run, at, held, n_held = own, 0, [], 0
            for part in _parts((text.as_py() or b"").decode("utf-8", "replace")):
                held.append(np.array(encode(part), "<u2"))
                n_held += len(held[-1])
                if n_held >= portion:
                    yield out()
                    at, held, n_held = at + n_held, [], 0
            held.append(np.array([END], "<u2"))
            n_held += 1
    if held:
        yield out()


def token_stream(docs: DataFrame, text_col: str = "text", order_by: Sequence[str] | None = None, vocabulary: str = VOCABULARY, portion: int = PORTION) -> DataFrame:
    """(file, block, at, n, ids) portions of the token stream of ``docs``, written.

    Without ``order_by``, ``docs`` is read from files, and the stream follows their names and rows; else it follows the named
    columns, then the texts, at the cost of a shuffle by ranges. Null and empty texts give END alone; bytes that are not
    UTF-8 are tokenised as U+FFFD; every row is tokenised whole, rows with null or repeated ids too; other columns are not read.
    """
    text = F.col(text_col).cast("string").alias("text")
    if order_by is None:
        rows = docs.select(text, F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    else:
        order = [f"o{k}" for k in range(len(order_by))]
        named = docs.select(text, *(F.col(c).alias(o) for c, o in zip(order_by, order, strict=True)), F.monotonically_increasing_id().alias("tie"))
        named = named.withColumn("digest", F.md5(F.col("text").cast("binary")))
        # equal rows differ by the tie alone, so that ranges can split any number of them; any order of theirs is the same stream
        ranged = named.repartitionByRange(partitions(docs.sparkSession), *order, "digest", "tie").sortWithinPartitions(*order, "digest", "tie")
        rows = ranged.select("text", F.lit("").alias("file"), F.spark_partition_id().cast("long").alias("block"))
    return written(rows.mapInArrow(functools.partial(_stream, vocabulary, portion), "file string, block long, at long, n int, ids binary"), "token-stream", compression="none")


def permuted(numbers, n: int, key: int = KEY):
    """Slots of numbers below ``n``: a bijection of 0 to n - 1 for each key."""
    import numpy as np

    half = max(1, ((n - 1).bit_length() + 1) // 2)
    low = np.uint64((1 << half) - 1)
    keys = [np.uint64(int.from_bytes(hashlib.sha256(f"{key}/{r}".encode()).digest()[:8], "little")) for r in range(ROUNDS)]

    def network(x):
        left, right = x >> np.uint64(half), x & low
        for k in keys:
            mixed = (right ^ k) * np.uint64(0xBF58476D1CE4E5B9)
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((mixed ^ (mixed >> np.uint64(29))) & low)
        return left << np.uint64(half) | right

    x = network(np.asarray(numbers, np.uint64))
    while len(beyond := np.flatnonzero(x >= np.uint64(n))):  # walks the cycle back into range: under four turns on average
        x[beyond] = network(x[beyond])
    return x.astype(np.int64)


def _cut(n: int, key: int, length: int, batches: Iterator) -> Iterator:
    """The portions cut at the ends of sequences: (slot, pos: ids before it in the sequence, ids)."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for start, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            ids = unpacked(data.as_py())
            first = start // length
            cuts = np.arange(first + 1, (start + len(ids) - 1) // length + 1) * length - start
            parts = np.split(ids, cuts)
            slots = permuted(np.arange(first, first + len(parts)), n, key)
            pos = [start % length] + [0] * (len(parts) - 1)
            yield pa.record_batch([pa.array(slots, pa.int64()), pa.array(pos, pa.int32()), pa.array([packed(p) for p in parts], pa.binary())], names=["slot", "pos", "ids"])


def training_order(stream: DataFrame, length: int = LENGTH, shard_records: int = SHARD_RECORDS, key: int = KEY) -> DataFrame:
    """(shard, slot, pos, ids: packed) from a written token stream: ranges of shards, sorted by slot and place inside it.

    Every slot below the number of sequences is there once, as one or more parts. An empty stream gives no rows.
    """
    runs = stream.groupBy("file", "block").agg(F.sum("n").alias("n"))
    # one row for each split of the input, in one window: names and sums, no texts
    base = F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    runs = written(runs.select("file", "block", "n", base.alias("base")), "token-runs")
    total = runs.agg(F.sum("n")).first()[0] or 0
    records = -(-total // length)
    shards = max(1, -(-records // shard_records))
    placed = stream.join(small(runs.drop("n")), ["file", "block"]).select((F.col("base") + F.col("at")).alias("start"), "ids")
    parts = placed.mapInArrow(functools.partial(_cut, max(records, 1), key, length), "slot long, pos int, ids binary")
    parts = parts.select(F.floor(F.col("slot") / shard_records).cast("int").alias("shard"), "slot", "pos", "ids")
    n = max(-(-shards // PARTITION_SHARDS), min(shards, partitions(stream.sparkSession)))
    return parts.repartitionById(n, F.floor(F.col("shard").cast("long") * n / shards).cast("int")).sortWithinPartitions("slot", "pos")


def _write(folder: str, length: int, shard_records: int, batches: Iterator) -> Iterator:
    import uuid

    import numpy as np
    import pyarrow as pa
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    shard = slot = part = target = None
    at, n, digest = 0, 0, hashlib.sha256()

    def put(ids):
        data = np.ascontiguousarray(ids, "<u2").tobytes()
        target.write(data)
        digest.update(data)

    def ended():
        """Fills the record up: only the last of the stream is short, as the others' parts join without a gap."""
        if slot is not None and at < length:
            put(np.full(length - at, END, "<u2"))

    def done():
        target.close()
        name = f"{path}/shard-{shard:08d}.bin"
        # whole or not at all; another attempt at the task finds or writes the same bytes
        if store.get_file_info(name).type == fs.FileType.NotFound:
            store.move(part, name)
        else:
            store.delete_file(part)
        return pa.record_batch([pa.array([shard], pa.int32()), pa.array([shard * shard_records], pa.int64()), pa.array([n], pa.int64()), pa.array([f"{folder}/shard-{shard:08d}.bin"]), pa.array([digest.hexdigest()])], names=["shard", "first_slot", "n_records", "path", "sha256"])

    for batch in batches:
        for k, s, p, data in zip(*(batch.column(c).to_pylist() for c in range(3)), batch.column(3), strict=True):
            if s != slot:
                ended()
                if k != shard:
                    if target is not None:
                        yield done()
                    shard, part = k, f"{path}/.{k:08d}-{uuid.uuid4().hex}"
                    target, n, digest = store.open_output_stream(part), 0, hashlib.sha256()
                if s != shard * shard_records + n:
                    raise ValueError(f"slot {shard * shard_records + n} is missing")
                slot, at, n = s, 0, n + 1
            if p != at:
                raise ValueError(f"slot {s} lacks ids {at} to {p}")
            ids = unpacked(data.as_py())
            put(ids)
            at += len(ids)
    ended()
    if target is not None:
        yield done()


def write_shards(ordered: DataFrame, folder: str, length: int = LENGTH, shard_records: int = SHARD_RECORDS) -> DataFrame:
    """Writes one binary file a shard into ``folder`` (a URI that all executors reach): (shard, first_slot, n_records, path, sha256).

    A missing slot or part of one is an error. The rows are to be written once: each reading of them writes the files again.
    """
    kinds = "shard int, first_slot long, n_records long, path string, sha256 string"
    return ordered.select("shard", "slot", "pos", "ids").mapInArrow(functools.partial(_write, folder, length, shard_records), kinds)


def read_records(folder: str, slot: int, n: int, length: int = LENGTH, shard_records: int = SHARD_RECORDS) -> list[list[int]]:
    """``n`` sequences from a slot on: a reader resumes by one seek in one shard."""
    import numpy as np
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    out: list[list[int]] = []
    while len(out) < n:
        shard, k = divmod(slot + len(out), shard_records)
        name = f"{path}/shard-{shard:08d}.bin"
        if store.get_file_info(name).type == fs.FileType.NotFound:
            break  # the end of the last shard
        with store.open_input_file(name) as f:
            f.seek(k * 2 * length)
            got = np.frombuffer(f.read(min(n - len(out), shard_records - k) * 2 * length), "<u2").reshape(-1, length)
        if not len(got):
            break
        out += got.tolist()
    return out
