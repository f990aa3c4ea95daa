"""Keys of events, boards and clients, and small scalars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlake.functions.binding import let


def actor_key(actor_id: Column, session_id: Column) -> Column:
    """Who did it: the actor, else the session, else null (funnels and retention skip the event)."""
    return F.coalesce(actor_id, session_id)


def partition_key(session_id: Column, actor_id: Column, event_id: Column) -> Column:
    """The log's key: events of one session, else actor, keep their order."""
    return F.coalesce(session_id, actor_id, event_id)


def board_key(project_id: Column, period: Column) -> Column:
    return F.concat_ws(":", F.lit("lb"), project_id, period)


def round4(x: Column) -> Column:
    return F.round(x, 4)


def fingerprint(secret: Column) -> Column:
    return F.sha2(secret, 256)


def retry_seconds(ms: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(ms / 1000)).cast("long")


def api_key_parts(key: Column) -> Column:
    """A struct (prefix, secret) split at the first dot; null unless both have text and the prefix starts ``cas_``."""
    dot = F.instr(key, ".")
    prefix, secret = F.substring(key, F.lit(1), dot - 1), F.substring(key, dot + 1, F.length(key))
    return F.when((dot > 1) & (dot < F.length(key)) & prefix.startswith("cas_"), F.struct(prefix.alias("prefix"), secret.alias("secret")))


def uuid_of(*parts: Column) -> Column:
    """A text shaped as a UUID from the coordinates of a record: the same whenever a task is run again."""
    h = F.sha2(F.concat_ws("|", *(p.cast("string") for p in parts)), 256)
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


#: Of the log's key hash (fixed values: the multiplier, the seed, and the bits that are kept).
_TIMES, _SEED, _WORD = 0x5BD1E995, 0x9747B28C, 0xFFFFFFFF


def _times(x: Column) -> Column:
    """A 32-bit number times the multiplier, modulo 2 to the 32nd: by halves, as the product has no long."""
    low, high = _TIMES & 0xFFFF, _TIMES >> 16
    return let(x, lambda x: (x * F.lit(low) + F.shiftleft((x * F.lit(high)).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_WORD)))


def _folded(x: Column, bits: int) -> Column:
    return let(x, lambda x: x.bitwiseXOR(F.shiftright(x, bits)))


def key_hash(key: Column) -> Column:
    """The 32-bit hash by which the log's producers deal keys: Murmur2 over the UTF-8 bytes.

    What a step uses twice is bound first: written out, each step would double all those before it.
    """
    start = F.lit(_SEED)

    def word(data: Column, at: Column) -> Column:
        """The bytes of a place's word that are there, the first the lowest."""
        byte = lambda k: F.substring(data, 8 * at + (2 * k + 1), F.lit(2))
        return F.conv(F.concat(*map(byte, (3, 2, 1, 0))), 16, 10).cast("long")

    def hashed(data: Column) -> Column:
        n = F.length(data) / 2
        whole = F.floor(n / 4).cast("int")
        mixed = lambda h, at: _times(h).bitwiseXOR(_times(_folded(_times(word(data, at)), 24)))
        words = F.when(whole > 0, F.sequence(F.lit(0), whole - 1)).otherwise(F.array().cast("array<int>"))
        h = F.aggregate(words, start.bitwiseXOR(n.cast("long")), mixed)
        h = let(h, lambda h: F.when(n % 4 > 0, _times(h.bitwiseXOR(word(data, whole)))).otherwise(h))
        return _folded(_times(_folded(h, 13)), 15)

    return let(F.hex(key.cast("binary")), hashed)


def key_partition(key: Column, partitions: int) -> Column:
    """The partition of a key: the hash without its sign, modulo the number of partitions."""
    return (key_hash(key).bitwiseAND(F.lit(0x7FFFFFFF)) % partitions).cast("int")
