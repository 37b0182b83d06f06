"""Declared tables: typed, non-nullable columns with defaults, indexes and uniques.

A declaration becomes a Spark ``StructType`` whose field metadata carries the rest. It
serialises to canonical JSON, and the MD5 of that names the schema's version.
"""

from __future__ import annotations

import hashlib
import json
import keyword
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import types as T

#: Declared type to Spark type. Unsigned types take the next wider signed one.
SPARK_TYPES: dict[str, T.DataType] = {
    "bool": T.ByteType(), "int8": T.ByteType(), "int16": T.ShortType(), "int32": T.IntegerType(), "int64": T.LongType(),
    "uint8": T.ShortType(), "uint16": T.IntegerType(), "uint32": T.LongType(), "uint64": T.DecimalType(20, 0),
    "float16": T.FloatType(), "float32": T.FloatType(), "float64": T.DoubleType(),
}
INT_RANGES = {f"{u}int{b}": ((0, 2**b - 1) if u else (-(2 ** (b - 1)), 2 ** (b - 1) - 1)) for u in ("", "u") for b in (8, 16, 32, 64)}
_WIDTH = re.compile(r"([US])([1-9][0-9]*)")


def normal_type(name: str) -> str:
    """A declared type's own name; booleans are stored as int8."""
    if name in ("bool", "bool_", "?"):
        return "int8"
    if name in SPARK_TYPES or _WIDTH.fullmatch(name):
        return name
    raise ValueError(f"unknown or unsupported type {name!r}")


def spark_type(name: str) -> T.DataType:
    name = normal_type(name)
    if m := _WIDTH.fullmatch(name):
        return T.StringType() if m[1] == "U" else T.BinaryType()
    return SPARK_TYPES[name]


def text_width(name: str) -> int | None:
    """Characters that a text or bytes column holds; None for other types."""
    m = _WIDTH.fullmatch(name)
    return int(m[2]) if m else None


@dataclass(frozen=True)
class Column:
    dtype: str
    default: Any
    index: bool = False
    unique: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "dtype", normal_type(self.dtype))
        if self.default is None:
            raise ValueError("a column needs a default; nulls are not stored")
        if self.unique:
            object.__setattr__(self, "index", True)
        bounds = INT_RANGES.get(self.dtype)
        if bounds and (isinstance(self.default, float) or not bounds[0] <= int(self.default) <= bounds[1]):
            raise ValueError(f"default {self.default!r} does not fit {self.dtype}")
        if isinstance(self.default, str) and self.dtype[0] != "U":
            raise ValueError(f"default {self.default!r} does not fit {self.dtype}")


@dataclass(frozen=True)
class Table:
    """A declared table. ``id`` and ``_version`` are added to every one."""

    name: str
    columns: dict[str, Column]
    permission: str = "USER"
    volatile: bool = False
    rls: tuple[str, str, str] | None = None

    def __post_init__(self) -> None:
        for name in self.columns:
            if name in ("id", "_version") or keyword.iskeyword(name) or not name.isidentifier():
                raise ValueError(f"a column cannot be named {name!r}")
        if self.permission == "OWNER" and "owner" not in self.columns:
            raise ValueError("OWNER permission needs a column named owner")
        if self.permission == "RLS" and self.rls is None:
            raise ValueError("RLS permission needs a rule")
        own = {"id": Column("int64", 0, unique=True), "_version": Column("int32", 0)}
        object.__setattr__(self, "columns", dict(sorted({**self.columns, **own}.items())))

    def struct(self) -> T.StructType:
        return T.StructType([T.StructField(n, spark_type(c.dtype), False, {"dtype": c.dtype, "default": c.default, "index": c.index, "unique": c.unique}) for n, c in self.columns.items()])

    def to_json(self) -> str:
        columns = {n: [c.dtype, c.default, c.index, c.unique] for n, c in self.columns.items()}
        return json.dumps({"name": self.name, "permission": self.permission, "volatile": self.volatile, "rls": self.rls, "columns": columns}, sort_keys=True, separators=(",", ":"))

    @staticmethod
    def from_json(text: str) -> Table:
        d = json.loads(text)
        columns = {n: Column(t, v, i, u) for n, (t, v, i, u) in d["columns"].items() if n not in ("id", "_version")}
        return Table(d["name"], columns, d["permission"], d["volatile"], tuple(d["rls"]) if d["rls"] else None)

    def version(self) -> str:
        return hashlib.md5(self.to_json().encode()).hexdigest()

    def duplicate(self, suffix: str) -> Table:
        """The same schema for separate data."""
        own = {n: c for n, c in self.columns.items() if n not in ("id", "_version")}
        return Table(f"{self.name}:{suffix}", own, self.permission, self.volatile, self.rls)


def status(stored_json: str | None, stored_cluster: int | None, table: Table, cluster: int) -> str:
    """``not_exists``, ``cluster_mismatch``, ``schema_mismatch`` or ``ok``; the cluster counts first."""
    if stored_json is None:
        return "not_exists"
    if stored_cluster != cluster:
        return "cluster_mismatch"
    return "ok" if hashlib.md5(stored_json.encode()).hexdigest() == table.version() else "schema_mismatch"
