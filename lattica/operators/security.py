"""Row-level security and table permissions, for what clients subscribe to."""

from __future__ import annotations

import math
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UNSET = object()
#: What a row's value is compared as, by the type of the caller's.
_KINDS = {bool: "boolean", int: "bigint", float: "double", str: "string"}
OPERATORS = ("eq", "ne", "lt", "le", "gt", "ge", "contains")


@dataclass(frozen=True)
class Caller:
    """Who asks: its own attributes, and data that the application keeps with it."""

    user_id: int = 0
    is_admin: bool = False
    user_data: Mapping[str, Any] = field(default_factory=dict)
    group: str = ""
    address: str = ""
    connection_id: int = 0
    timestamp: float = 0.0

    @property
    def caller(self) -> int:
        return self.user_id

    def value(self, attribute: str) -> Any:
        """An attribute of the caller, then of its data; NaN where neither has it."""
        own = getattr(self, attribute, _UNSET)
        return self.user_data.get(attribute, math.nan) if own is _UNSET else own


def rls_predicate(rule: tuple[str, str, str], caller: Caller) -> Column:
    """``operator(row[column], caller[attribute])``; admins see all, a missing attribute denies.

    The row's value is compared as the type of the caller's: a number column with a text
    attribute as text, a text column with a number as a number.
    """
    operator, column, attribute = rule
    if operator not in OPERATORS:
        raise ValueError(f"unknown operator {operator!r}")
    if caller.is_admin:
        return F.lit(True)
    value = caller.value(attribute)
    if isinstance(value, float) and math.isnan(value):
        return F.lit(False)
    c = F.col(column).try_cast(_KINDS[type(value)]) if type(value) in _KINDS else F.col(column)
    if operator == "contains":
        return c.contains(F.lit(value))
    return {"eq": c == value, "ne": c != value, "lt": c < value, "le": c <= value, "gt": c > value, "ge": c >= value}[operator]


def secured(rows: DataFrame, rule: tuple[str, str, str], caller: Caller) -> DataFrame:
    """The rows that the caller may see. Applied to a limited range it stays above the
    limit, so fewer rows than the limit may remain."""
    return rows.where(rls_predicate(rule, caller))


OWNER_RULE = ("eq", "owner", "caller")


def may_read(permission: str, caller: Caller) -> bool:
    """The table gate, before any plan is made; unknown levels are refused."""
    if caller.is_admin or permission == "EVERYBODY":
        return True
    return permission in ("USER", "OWNER", "RLS") and caller.user_id > 0
