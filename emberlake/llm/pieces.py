"""Sampled SentencePiece segmentation by forward filtering and backward sampling over the piece lattice.

A text is cut where no piece can reach across (before runs of spaces, around line ends). For each different stretch of
a batch, forward filtering sums the probabilities of all segmentations up to each character; then every occurrence
draws its pieces backward, from the last character to the first. The draws are a hash of (seed, row key, stretch, step),
so a row has the same pieces in any batch, partition or retry. Characters that no piece covers, and a literal U+2581,
become byte pieces, so decoding gives back every text exactly.

The model's file is a BPE vocabulary whose scores are ranks; a piece's weight follows Zipf's law over its id.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SEED = 20240101
#: Characters that are segmented at once: bounds memory. A longer text is taken in parts that end where stretches do.
BATCH_CHARS = 500_000
#: A longer stretch is filtered in windows of so many characters, with the sums at their borders kept.
LONG = 1 << 16
STRETCH = re.compile(r" *[^ \n]+|\n| +")
_BORDER = re.compile(r"(?<=[^ ])(?= )|(?=\n)")


class Lattice:
    """The pieces of a model as a sorted transition table, and sampling over it."""

    def __init__(self, model: str):
        import numpy as np
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(model, "rb") as f:
            proto.ParseFromString(f.read())
        self.n = len(proto.pieces)
        self.bytes = [b""] * self.n
        self.byte_id = [0] * 256
        first, trie = None, [{}]
        piece_at = [-1]
        for k, p in enumerate(proto.pieces):
            if p.type == 6:  # a byte
                b = int(p.piece[3:5], 16)
                self.byte_id[b], self.bytes[k] = k, bytes([b])
            elif p.type == 1:
                first = k if first is None else first
                text = p.piece.replace("▁", " ")
                self.bytes[k], node = text.encode(), 0
                for c in map(ord, text):
                    if c not in trie[node]:
                        trie[node][c] = len(trie)
                        trie.append({})
                        piece_at.append(-1)
                    node = trie[node][c]
                piece_at[node] = k
        edges = sorted((node << 21 | c, child) for node, out in enumerate(trie) for c, child in out.items())
        self.keys = np.array([k for k, _ in edges], np.int64)
        self.child = np.array([c for _, c in edges], np.int64)
        self.piece_at = np.array(piece_at, np.int64)
        weight = 1.0 / (np.arange(self.n, dtype=float) - first + 10.0).clip(10.0)
        self.logp = np.log(weight / weight[first:].sum())
        self.rare = self.logp.min() - 2.0  # of a character that only bytes can give
        self.longest = max(len(p.piece) for p in proto.pieces)

    def arcs(self, codes, ends):
        """All (start, end, piece) over the characters; ``ends``: where each character's stretch ends. Piece n + c: the bytes of c."""
        import numpy as np

        at = np.arange(len(codes))
        node, length, found = np.zeros(len(codes), np.int64), 0, []
        covered = np.zeros(len(codes), bool)
        while len(at):
            key = node << 21 | codes[at + length]
            k = np.searchsorted(self.keys, key).clip(max=len(self.keys) - 1)
            ok = self.keys[k] == key
            at, node, length = at[ok], self.child[k[ok]], length + 1
            piece = self.piece_at[node]
            end = piece >= 0
            found.append((at[end], at[end] + length, piece[end]))
            if length == 1:
                covered[at[end]] = True
            more = at + length < ends[at]
            at, node = at[more], node[more]
        bare = np.flatnonzero(~covered)
        found.append((bare, bare + 1, self.n + codes[bare]))
        start, end, piece = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((start, end))
        return start[order], end[order], piece[order]

    def backward(self, codes, begins, ends, alpha: float = 1.0):
        """For every character, the choices of the piece that ends there, as steps of a running sum.

        Returns (cumulated, start, piece): the draw u in [0, 1) of character k picks the first arc whose sum exceeds k + u.
        """
        import numpy as np

        start, end, piece = self.arcs(codes, ends)
        logp = alpha * np.where(piece < self.n, self.logp[piece.clip(max=self.n - 1)], self.rare)
        total = np.zeros(len(codes) + 1)  # forward log-probability at the end of each character
        own = end - 1
        depth = own - begins[own]  # the place within the stretch: all stretches advance together
        order = np.argsort(depth, kind="stable")
        cuts = np.concatenate(([0], np.flatnonzero(np.diff(depth[order])) + 1, [len(order)]))
        scored = np.empty(len(own))
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            now = order[a:b]
            before = np.where(start[now] == begins[own[now]], 0.0, total[start[now] - 1])
            score = before + logp[now]
            scored[now] = score
            ending = own[now]
            groups = np.concatenate(([0], np.flatnonzero(np.diff(ending)) + 1))
            total[ending[groups]] = np.logaddexp.reduceat(score, groups)
        share = np.exp(scored - total[own])
        firsts = np.concatenate(([0], np.flatnonzero(np.diff(own)) + 1))
        run = np.cumsum(share)
        base = np.repeat(run[firsts] - share[firsts], np.diff(np.concatenate((firsts, [len(own)]))))
        cumulated = own + np.minimum(run - base, 1.0)
        cumulated[np.concatenate((firsts[1:] - 1, [len(own) - 1]))] = np.arange(1, len(codes) + 1)
        return cumulated, start, piece

    def _window(self, codes, begin: int, end: int, before: list[float], alpha: float):
        """Of the characters from ``begin`` to ``end`` of one stretch: the arcs that end at each, and the forward sums.

        ``before``: the sums of the last ``longest`` characters ahead of ``begin``, the stretch's start (0.0) among them.
        """
        import numpy as np

        low = begin - len(before) + 1
        start, stop, piece = self.arcs(codes[low:end], np.full(end - low, end - low))
        logp = alpha * np.where(piece < self.n, self.logp[piece.clip(max=self.n - 1)], self.rare)
        total = {low + k: x for k, x in enumerate(before)}  # of the segmentations of all that lies before a place
        ending: list[list] = [[] for _ in range(end - begin)]
        for s, e, p, x in zip((start + low).tolist(), (stop + low).tolist(), piece.tolist(), logp.tolist(), strict=True):
            if e > begin:
                ending[e - begin - 1].append((s, p, x))
        for k, arcs in enumerate(ending):
            scores = [total[s] + x for s, _, x in arcs]
            top = max(scores)
            total[begin + k + 1] = top + math.log(sum(math.exp(x - top) for x in scores))
        return ending, total

    def sample_long(self, stretch: str, salt: int, alpha: float = 1.0) -> list[int]:
        """The piece ids of one stretch of any length, in memory for LONG characters and the ids: windows are filtered
        forward for the sums at their borders, and once more, from the last to the first, while pieces are drawn."""
        import numpy as np

        codes = np.frombuffer(_codes(stretch), np.uint32).astype(np.int64)
        borders, befores = list(range(0, len(codes), LONG)), [[0.0]]
        for a in borders[:-1]:
            _, total = self._window(codes, a, a + LONG, befores[-1], alpha)
            befores.append([total[k] for k in range(max(0, a + LONG - self.longest), a + LONG + 1)])
        out, at, step = [], len(codes), 0
        for a, before in zip(reversed(borders), reversed(befores), strict=True):
            ending, total = self._window(codes, a, min(a + LONG, len(codes)), before, alpha)
            while at > a:
                u = (int(_mixed(np.array([salt + step * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF], np.uint64))[0]) >> 11) * 2.0**-53
                run, arcs = 0.0, ending[at - a - 1]
                for s, p, x in arcs:
                    run += math.exp(total[s] + x - total[at])
                    if u < run:
                        break
                out.append(p)
                at, step = s, step + 1
        return out[::-1]

    def sample(self, texts: list[str], keys: list[int], alpha: float = 1.0, first: bool = True):
        """The piece ids of each text as one array and the number of ids of each; ``keys``: 64 bits for each row; ``alpha``: as in ``encode``.

        ``first`` is false for texts that go on from a part before them: they have no dummy prefix.
        """
        import numpy as np

        index: dict[str, int] = {}
        which, sizes = [], []
        for t in texts:
            found = STRETCH.findall(" " + t if first else t)
            which += [index.setdefault(s, len(index)) for s in found]
            sizes.append(len(found))
        if not texts:
            return np.empty(0, np.int32), np.empty(0, np.int64)
        long = {k: s for s, k in index.items() if len(s) > LONG} if max(map(len, texts)) >= LONG else {}
        codes = np.frombuffer(_codes("".join(s for s in index if len(s) <= LONG)), np.uint32).astype(np.int64)
        lengths = np.fromiter((0 if k in long else len(s) for s, k in index.items()), np.int64, len(index))
        stops = np.cumsum(lengths)
        begins, ends = np.repeat(stops - lengths, lengths), np.repeat(stops, lengths)

        which, sizes = np.array(which, np.int64), np.array(sizes, np.int64)
        rows = np.repeat(np.array(keys, np.uint64), sizes)
        place = (np.arange(len(which)) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.uint64)
        salt = _mixed(rows + place * np.uint64(0x9E3779B97F4A7C15))
        drawn, owners = [], []
        left = np.flatnonzero(lengths[which])
        at = stops[which[left]] - 1
        if len(left):
            cumulated, start, piece = self.backward(codes, begins, ends, alpha)
        step = 0
        while len(left):
            u = (_mixed(salt[left] + np.uint64(step * 0xD1B54A32D192ED03 & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(11)) * 2.0**-53
            arc = np.searchsorted(cumulated, at + u * (1 - 2.0**-20), side="right")
            drawn.append(piece[arc])
            owners.append(left)
            begun = start[arc]
            more = begun > begins[at]
            left, at = left[more], begun[more] - 1
            step += 1
        counts = np.zeros(len(which), np.int64)
        for own in owners:
            counts[own] += 1
        apart = {int(o): self.sample_long(long[int(which[o])], int(salt[o]), alpha) for o in np.flatnonzero(lengths[which] == 0)}
        for o, ids in apart.items():
            counts[o] = len(ids)
        tail = np.cumsum(counts)
        out = np.empty(int(tail[-1]) if len(tail) else 0, np.int64)
        for k, (own, ids) in enumerate(zip(owners, drawn, strict=True)):
            out[tail[own] - 1 - k] = ids
        for o, ids in apart.items():
            out[tail[o] - len(ids) : tail[o]] = ids
        per_row = np.add.reduceat(np.append(counts, 0), np.minimum(np.cumsum(sizes) - sizes, len(counts))) * (sizes > 0)
        return self.spelt(out, per_row)

    def sample_all(self, texts: list[str], keys: list[int], alpha: float = 1.0):
        """As ``sample``; a text of over BATCH_CHARS, which comes alone, in parts with keys of their own."""
        import numpy as np

        if len(texts) != 1 or len(texts[0]) <= BATCH_CHARS:
            return self.sample(texts, keys, alpha)
        parts = [self.sample([t], [keys[0] + k * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF], alpha, not k)[0] for k, t in enumerate(parts_of(texts[0]))]
        ids = np.concatenate(parts)
        return ids, np.array([len(ids)], np.int64)

    def spelt(self, ids, per_row):
        """Characters given by bytes become their byte pieces."""
        import numpy as np

        bare = np.flatnonzero(ids >= self.n)
        if not len(bare):
            return ids.astype(np.int32), per_row
        spell = [[self.byte_id[b] for b in chr(c - self.n).encode("utf-8", "surrogateescape")] for c in ids[bare].tolist()]
        extra = np.array([len(s) - 1 for s in spell])
        row = np.repeat(np.arange(len(per_row)), per_row)
        per_row = per_row + np.bincount(row[bare], weights=extra, minlength=len(per_row)).astype(np.int64)
        repeats = np.ones(len(ids), np.int64)
        repeats[bare] += extra
        out = np.repeat(ids, repeats)
        wide = np.repeat(ids >= self.n, repeats)
        out[wide] = [b for s in spell for b in s]
        return out.astype(np.int32), per_row

    def decode(self, ids) -> bytes:
        """The UTF-8 bytes of the text of a list of piece ids, without the dummy prefix."""
        return b"".join([self.bytes[k] for k in ids])[1:]


def _codes(text: str) -> bytes:
    """Code points of 32 bits; a byte that isn't UTF-8 is one, from U+DC80 on."""
    return text.encode("utf-32-le", "surrogatepass")


def parts_of(text: str, most: int | None = None) -> Iterator[str]:
    """A text in parts of about ``most`` characters (BATCH_CHARS) that begin where a stretch does."""
    begin, most = 0, BATCH_CHARS if most is None else most
    while len(text) - begin > most and (cut := _BORDER.search(text, begin + most)) and cut.start() < len(text):
        yield text[begin : cut.start()]
        begin = cut.start()
    yield text[begin:]


def _mixed(x):
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def lattice(model: str) -> Lattice:
    return Lattice(model)


def _portions(batch):
    """Slices of a batch of about BATCH_CHARS; a single text is never cut."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_pylist()
    begin = total = 0
    for k, n in enumerate(sizes):
        if total and total + n > BATCH_CHARS:
            yield batch.slice(begin, k - begin)
            begin, total = k, 0
        total += n
    if begin < len(sizes):
        yield batch.slice(begin)


def _texts(column) -> list[str]:
    """The texts of an Arrow column, null as empty; bytes that aren't UTF-8 are kept as lone surrogates."""
    import pyarrow as pa

    return [(b.as_py() or b"").decode("utf-8", "surrogateescape") for b in column.cast(pa.binary())]


def _encode(model: str, seed: int, alpha: float, batches: Iterator) -> Iterator:
    import numpy as np
    import pyarrow as pa
    import xxhash

    for batch in batches:
        for part in _portions(batch):
            keys = [xxhash.xxh64_intdigest(str(k), seed) for k in part.column(0).to_pylist()]
            ids, counts = lattice(model).sample_all(_texts(part.column(1)), keys, alpha)
            offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
            yield pa.record_batch([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=["id", "piece_ids"])


def _decode(model: str, batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        decode = lattice(model).decode
        texts = pa.array([None if x is None else decode(x) for x in batch.column(1).to_pylist()], pa.binary())
        yield pa.record_batch([batch.column(0), texts.view(pa.string())], names=["id", "text"])


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, seed: int = SEED, alpha: float = 1.0) -> DataFrame:
    """One row (id, piece_ids: array of int) for each row of ``docs``; no shuffle.

    The row key is the id as text (a null id has a key of its own), so rows with one id and one text have one
    segmentation. A null text counts as empty, and an empty text is the dummy prefix alone. Bytes that are not UTF-8 become
    byte pieces like any others. Texts and words may be of any length. Other columns are not read.
    Weights are raised to ``alpha``: below 1, segmentations into more and rarer pieces come up oftener.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(functools.partial(_encode, model, seed, alpha), f"id {rows.schema['id'].dataType.simpleString()}, piece_ids array<int>")


def decode(rows: DataFrame, id_col: str = "id", ids_col: str = "piece_ids", model: str = MODEL) -> DataFrame:
    """One row (id, text) for each row; null piece ids give a null text."""
    picked = rows.select(F.col(id_col).alias("id"), F.col(ids_col).alias("piece_ids"))
    return picked.mapInArrow(functools.partial(_decode, model), f"id {picked.schema['id'].dataType.simpleString()}, text string")


def _round_trip(model: str, seed: int, alpha: float, batches: Iterator) -> Iterator:
    import hashlib

    import numpy as np
    import pyarrow as pa

    for batch in batches:
        for part in _portions(batch):
            texts = [t.as_py() or b"" for t in part.column(1).cast(pa.binary())]
            (coded,) = _encode(model, seed, alpha, iter([part]))
            lists = coded.column(1)
            ids, bounds = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_pylist()
            spelling, same, digest = lattice(model).bytes, [], []
            for text, a, b in zip(texts, bounds, bounds[1:], strict=False):
                same.append(b"".join([spelling[k] for k in ids[a:b].tolist()])[1:] == text)
                digest.append(hashlib.md5(np.ascontiguousarray(ids[a:b], "<i4").tobytes()).hexdigest())
            yield pa.record_batch([part.column(0), pa.array(np.diff(bounds), pa.int64()), pa.array(digest), pa.array(same)], names=["id", "n_pieces", "pieces_md5", "lossless"])


def round_trip(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, seed: int = SEED, alpha: float = 1.0) -> DataFrame:
    """``encode`` and back, in one pass: (id, n_pieces, pieces_md5 of the little-endian ids, lossless)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(functools.partial(_round_trip, model, seed, alpha), f"id {rows.schema['id'].dataType.simpleString()}, n_pieces long, pieces_md5 string, lossless boolean")
