"""Column expressions of the mutation model, all JVM-side."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.schema import ENTRY_OVERHEAD

MASK32 = (1 << 32) - 1
#: FNV-1a's 64-bit offset and prime, of which the low 32 bits evolve on their own.
FNV_OFFSET = 14695981039346656037
FNV_PRIME = 1099511628211

VERSION = ("ts", "seq", "tombstone", "value")


def version() -> Column:
    """What a mutation is ordered by among those of its key.

    Rows of one batch that a table brought share a ``seq``; where even that is equal, a delete wins, then the greatest value, so
    that no answer depends on where a row lies.
    """
    return F.struct(*VERSION)


def entry_bytes(key: str = "key", value: str = "value", tombstone: Column | None = None) -> Column:
    """Bytes that an entry is accounted for; a tombstone has no value. Lengths are in bytes and not in characters."""
    stored = F.coalesce(F.octet_length(value), F.lit(0))
    if tombstone is not None:
        stored = F.when(tombstone, F.lit(0)).otherwise(stored)
    return (F.octet_length(key) + stored + ENTRY_OVERHEAD).cast("long")


def entry_crc(*columns: Column | str) -> Column:
    """CRC-32 of the columns' texts, each behind its length, so that neighbours can't run into each other."""
    texts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.crc32(F.concat(*[x for t in texts for x in (F.coalesce(F.octet_length(t).cast("string"), F.lit("-")), F.lit(":"), F.coalesce(t, F.lit("")))]).cast("binary"))


def fnv32(key: Column | str, prefix: str = "") -> Column:
    """The low 32 bits of the 64-bit FNV-1a of ``prefix`` and a string's UTF-8 bytes.

    The prime is 2^40 + 435, so a product's low half depends on low halves only and fits a long, as ANSI mode asks.
    """
    key = F.col(key) if isinstance(key, str) else key
    start = FNV_OFFSET
    for b in prefix.encode():
        start = (start ^ b) * FNV_PRIME & (1 << 64) - 1
    # each byte as a character of its own; the array is made once, as what a lambda refers to is not
    octets = F.filter(F.split(F.decode(F.encode(key, "UTF-8"), "ISO-8859-1"), ""), lambda x: x != "")
    return F.aggregate(octets, F.lit(start & MASK32).cast("long"), lambda h, x: (h.bitwiseXOR(F.ascii(x).cast("long")) * (FNV_PRIME & MASK32)).bitwiseAND(F.lit(MASK32)))


def rate(part: Column, whole: Column, otherwise: float = 0.0) -> Column:
    """``part / whole``, or ``otherwise`` where there is nothing to divide by."""
    return F.when(whole > 0, part.cast("double") / whole.cast("double")).otherwise(F.lit(otherwise))
