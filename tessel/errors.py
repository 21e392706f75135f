"""Named errors, and their recovery from the conditions that Spark reports."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.errors import PySparkException


class TesselError(Exception):
    """Base of all named errors; ``name`` is what callers match on."""

    @property
    def name(self) -> str:
        return type(self).__name__


def _named(names: str) -> dict[str, type[TesselError]]:
    return {n: type(n, (TesselError,), {"__module__": __name__}) for n in names.split()}


# The error names of the compute, table, batch, layout and interchange layers.
KERNEL = _named(
    "OutOfMemory FunctionNotFound InvalidArity InvalidOptions InvalidInput Overflow DivideByZero InvalidCast UnsupportedType NotImplemented MissingLifecycle AggregateStateMismatch NoMatchingKernel"
)
TABLES = _named(
    "UnknownField IndexOutOfBounds SliceOutOfBounds InvalidColumnCount InvalidColumnLength InvalidColumnType NullInNonNullableField ColumnAlreadySet MissingColumn InvalidColumnIndex AlreadyFinished NotFinished InvalidChunkType LengthOverflow SchemaMismatch"
)
LAYOUT = _named("InvalidBufferCount BufferTooSmall InvalidOffsetBuffer InvalidOffsets InvalidNullCount OffsetOverflow MissingDictionary InvalidChildren InvalidRunEnds InvalidTypeId IndexOutOfRange InvalidEntriesType InvalidEntriesSchema InvalidChildLength")
INTERCHANGE = _named("InvalidMessage InvalidMetadata InvalidBody InvalidFile SchemaNotRead Released TopLevelSchemaMustBeStruct")

_ALL = KERNEL | TABLES | LAYOUT | INTERCHANGE
globals().update(_ALL)


def named(name: str, message: str = "") -> TesselError:
    return _ALL[name](message or name)


#: Spark's error conditions by the name they stand for.
CONDITIONS = {
    "ARITHMETIC_OVERFLOW": "Overflow",
    "BINARY_ARITHMETIC_OVERFLOW": "Overflow",
    "DIVIDE_BY_ZERO": "DivideByZero",
    "CAST_OVERFLOW": "InvalidCast",
    "CAST_INVALID_INPUT": "InvalidCast",
    "CAST_OVERFLOW_IN_TABLE_INSERT": "InvalidCast",
    "NOT_NULL_ASSERT_VIOLATION": "NullInNonNullableField",
    "UNSUPPORTED_DATA_TYPE_FOR_ARROW_CONVERSION": "UnsupportedType",
}
RAISED = "tessel:"


def marker(name: str) -> str:
    """The message with which a plan raises a named error at run time."""
    return f"{RAISED}{_ALL[name].__name__}"


def translate(error: Exception) -> Exception:
    """The named error behind one of Spark's, or the error itself."""
    text = str(error)
    if (at := text.find(RAISED)) >= 0:
        word = text[at + len(RAISED) :].split()[0].strip(".,;:'\"]")
        if word in _ALL:
            return named(word, text[:400])
    condition = error.getCondition() if isinstance(error, PySparkException) else None
    for key, name in CONDITIONS.items():
        if (condition or "").split(".")[0] == key or f"[{key}" in text:
            return named(name, text[:400])
    return error


@contextmanager
def naming() -> Iterator[None]:
    """Within it, Spark's errors surface under their names."""
    try:
        yield
    except TesselError:
        raise
    except Exception as error:
        found = translate(error)
        if found is error:
            raise
        raise found from error
