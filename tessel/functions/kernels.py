"""The functions themselves, as Columns that stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from tessel.errors import marker, named
from tessel.functions.datum import Datum, binary_same_numeric, execution_length, unary_numeric
from tessel.functions.registry import Context, Kernel, Lifecycle, Registry, Signature
from tessel.options import ArithmeticOptions, CastOptions, NoOptions, Options

LOW, HIGH = -(2**63), 2**63 - 1


def add_checked(a: Column, b: Column) -> Column:
    """try_add tells overflow from null without relying on the session's ANSI setting."""
    total = F.try_add(a, b)
    overflow = total.isNull() & a.isNotNull() & b.isNotNull()
    return F.when(overflow, F.raise_error(F.lit(marker("Overflow"))).cast("long")).otherwise(total)


def add_wrapping(a: Column, b: Column) -> Column:
    """Two's complement: halves of 32 bits are added with a carry, which can't overflow."""
    mask = F.lit(0xFFFFFFFF)
    low = a.bitwiseAND(mask) + b.bitwiseAND(mask)
    high = F.shiftright(a, 32) + F.shiftright(b, 32) + F.shiftright(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(mask))


def add_saturating(a: Column, b: Column) -> Column:
    total = F.try_add(a, b)
    edge = F.when(a > 0, F.lit(HIGH)).otherwise(F.lit(LOW))
    return F.when(a.isNotNull() & b.isNotNull(), F.coalesce(total, edge))


def add(a: Column, b: Column, options: ArithmeticOptions = ArithmeticOptions()) -> Column:
    if options.check_overflow:
        return add_checked(a, b)
    return add_saturating(a, b) if options.saturate else add_wrapping(a, b)


def divide(a: Column, b: Column, options: ArithmeticOptions = ArithmeticOptions()) -> Column:
    """Towards zero. Division by zero is an error or 0; the lowest value by -1 an error or, unchecked, itself."""
    a, b = a.cast("long"), b.cast("long")
    zero = F.raise_error(F.lit(marker("DivideByZero"))).cast("long") if options.divide_by_zero_is_error else F.lit(0).cast("long")
    over = F.raise_error(F.lit(marker("Overflow"))).cast("long") if options.check_overflow else F.lit(HIGH if options.saturate else LOW)
    return F.when(a.isNull() | b.isNull(), F.lit(None).cast("long")).when(b == 0, zero).when((a == LOW) & (b == -1), over).otherwise(F.call_function("div", a, b))


def cast_to_int(c: Column, options: CastOptions = CastOptions()) -> Column:
    """64 to 32 bits: safe casts fail out of range, others keep the low 32 bits."""
    if options.to_type is not None and not isinstance(options.to_type, IntegerType):
        raise named("InvalidCast", options.to_type.simpleString())
    low = F.shiftright(F.shiftleft(c.cast("long"), 32), 32).cast("int")
    if not options.safe:
        return low
    outside = ~c.between(-(2**31), 2**31 - 1)
    return F.when(outside, F.raise_error(F.lit(marker("InvalidCast"))).cast("int")).otherwise(low)


#: Bits of the integer types that a checked cast may aim at.
WIDTHS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}


def cast_checked(c: Column, to: str) -> Column:
    """A whole number into a narrower type, or InvalidCast."""
    bits = WIDTHS[to]
    inside = c.between(-(2 ** (bits - 1)), 2 ** (bits - 1) - 1)
    return F.when(c.isNull() | inside, c.cast(to)).otherwise(F.raise_error(F.lit(marker("InvalidCast"))).cast(to))


def identity(c: Column) -> Column:
    return c


def _longs(args: list[Datum]) -> bool:
    return binary_same_numeric(args) and isinstance(args[0].data_type, LongType)


def _arithmetic(options: Options) -> bool:
    return isinstance(options, (ArithmeticOptions, NoOptions))


def _options(context: Context, options: Options) -> ArithmeticOptions:
    return options if isinstance(options, ArithmeticOptions) else context.config.arithmetic()


def _binary(f):
    def run(context: Context, args: list[Datum], options: Options) -> Column:
        execution_length(args)
        return f(args[0].column, args[1].column, _options(context, options))

    return run


def _cast(context: Context, args: list[Datum], options: Options) -> Column:
    return cast_to_int(args[0].column, options if isinstance(options, CastOptions) else context.config.cast())


COUNT_ROWS = Lifecycle(init=lambda: 0, update=lambda n, batch: n + len(batch), merge=lambda a, b: a + b, finalize=lambda n: n)


def standard() -> Registry:
    """The functions that every context starts with."""
    r = Registry()
    r.vector("add_i64", Kernel(Signature.binary(type_check=_longs, options_check=_arithmetic), _binary(add)))
    r.vector("divide_i64", Kernel(Signature.binary(type_check=_longs, options_check=_arithmetic), _binary(divide)))
    cast_signature = Signature.unary(
        type_check=lambda args: unary_numeric(args) and isinstance(args[0].data_type, LongType),
        options_check=lambda o: isinstance(o, (CastOptions, NoOptions)),
        result_type=lambda args, o: IntegerType(),
    )
    r.vector("cast_i64_to_i32", Kernel(cast_signature, _cast))
    r.vector("identity_i32", Kernel(Signature.unary(type_check=lambda args: isinstance(args[0].data_type, IntegerType)), lambda c, args, o: identity(args[0].column)))
    count = Signature.unary(result_type=lambda args, o: LongType())
    r.aggregate("count_rows", Kernel(count, lambda c, args, o: F.count(F.lit(1)), COUNT_ROWS))
    return r


def context() -> Context:
    return Context(standard())


