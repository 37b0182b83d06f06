"""Ids and keys as column functions."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# Ids must be told apart as stored ones are.
#: Milliseconds since 1970 at which ids start counting; 41, 10 and 12 bits.
EPOCH_MS = 1_766_000_000_000


def pack_id(millis: Column, worker: Column, sequence: Column) -> Column:
    """Time, worker and sequence in one ordered 63-bit id."""
    time = F.shiftleft((millis - EPOCH_MS).cast("long"), 22)
    return time.bitwiseOR(F.shiftleft(worker.cast("long"), 12)).bitwiseOR(sequence.cast("long"))


def unpack_id(c: Column) -> tuple[Column, Column, Column]:
    """The time in milliseconds, worker and sequence of an id."""
    return F.shiftright(c, 22) + EPOCH_MS, F.shiftright(c, 12).bitwiseAND(F.lit(1023)), c.bitwiseAND(F.lit(4095))


def new_ids(millis: int) -> Column:
    """A new id for each row of a table to be written, unique within the write.

    A partition is a worker: its rows take sequences and then milliseconds from
    ``millis`` on; beyond 1024 partitions the next ones start a stretch of time later.
    """
    place = F.monotonically_increasing_id()
    partition, nth = F.shiftright(place, 33), place.bitwiseAND(F.lit((1 << 33) - 1))
    stretch = F.floor(partition / 1024) * F.lit(1 << 21)
    return pack_id(F.lit(millis) + stretch + F.shiftright(nth, 12), partition % 1024, nth.bitwiseAND(F.lit(4095)))


@F.pandas_udf(LongType())
def key_id(keys: pd.Series) -> pd.Series:
    """A negative id from a text key: 63 bits of BLAKE2b, which Spark lacks."""
    return keys.map(lambda k: -1 - (int.from_bytes(hashlib.blake2b(k.encode(), digest_size=8).digest(), "big") >> 1), na_action="ignore")


def sortable_hex(c: Column, kind: str) -> Column:
    """Hexadecimal text that sorts as the value does (``int`` of any width, ``double``, ``text`` or ``bytes``)."""
    if kind in ("text", "bytes"):
        return F.hex(c.cast("binary"))
    if kind == "int":
        return F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0")
    bits = _double_bits(c)
    return F.lpad(F.hex(F.when(bits < 0, F.bitwise_not(bits)).otherwise(bits.bitwiseXOR(F.lit(-(2**63))))), 16, "0")


@F.pandas_udf(LongType())
def _double_bits(values: pd.Series) -> pd.Series:
    return pd.Series(values.to_numpy("f8").view("i8"))


def subscription_id(table: str, index: str, left, right, limit: int | None = None, desc: bool = False) -> str:
    """The canonical name of a live query."""
    tail = f":{limit}" if limit is not None else ""
    return f"{table}.{index}[{left}:{right}:{-1 if desc else 1}]{tail}"


def fixed_text(c: Column, width: int) -> Column:
    """Text cut to a column's width, as writes store it."""
    return F.substring(c, 1, width)
