"""Option families of the compute functions, with their defaults."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from typing import Any

from pyspark.sql.types import DataType


class Order(Enum):
    ASCENDING = "ascending"
    DESCENDING = "descending"


class Placement(Enum):
    AT_START = "at_start"
    AT_END = "at_end"


class OverflowMode(Enum):
    CHECKED = "checked"
    WRAPPING = "wrapping"
    SATURATING = "saturating"


@dataclass(frozen=True)
class Options:
    @property
    def tag(self) -> str:
        return {"NoOptions": "none"}.get(type(self).__name__, type(self).__name__.removesuffix("Options").lower())


@dataclass(frozen=True)
class NoOptions(Options):
    pass


@dataclass(frozen=True)
class CastOptions(Options):
    safe: bool = True
    to_type: DataType | None = None


@dataclass(frozen=True)
class ArithmeticOptions(Options):
    check_overflow: bool = True
    divide_by_zero_is_error: bool = True
    #: Extension: what happens on overflow where it isn't checked.
    saturate: bool = False


@dataclass(frozen=True)
class FilterOptions(Options):
    drop_nulls: bool = True


@dataclass(frozen=True)
class SortOptions(Options):
    order: Order = Order.ASCENDING
    null_placement: Placement = Placement.AT_END
    nan_placement: Placement | None = None
    stable: bool = False


@dataclass(frozen=True)
class CustomOptions(Options):
    name: str = ""
    payload: Any = None


@dataclass(frozen=True)
class EngineConfig:
    """Defaults of a context; threads are Spark's matter and only kept for information."""

    safe_cast: bool = True
    overflow_mode: OverflowMode = OverflowMode.CHECKED
    threads: int = 0

    def arithmetic(self) -> ArithmeticOptions:
        return ArithmeticOptions(check_overflow=self.overflow_mode is OverflowMode.CHECKED, saturate=self.overflow_mode is OverflowMode.SATURATING)

    def cast(self, to_type: DataType | None = None) -> CastOptions:
        return CastOptions(self.safe_cast, to_type)
