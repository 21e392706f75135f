"""Functions by kind and name, with overloads chosen by arity, types and options.

Everything here happens on the driver while a plan is built; what a kernel returns is a
Column (scalar and vector functions) or an aggregate, which Catalyst then executes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql.types import DataType

from tessel.errors import named
from tessel.functions.datum import Datum
from tessel.options import EngineConfig, NoOptions, Options


class Kind(Enum):
    SCALAR = "scalar"
    VECTOR = "vector"
    AGGREGATE = "aggregate"


class Arity(Enum):
    """Models of argument counts; the value is how specific each is."""

    EXACT = 3
    RANGE = 2
    AT_LEAST = 1


# The diagnostics that callers compare.
MISMATCH = {
    Arity.EXACT: "arity mismatch: argument count does not match exact kernel arity",
    Arity.AT_LEAST: "arity mismatch: argument count is below minimum kernel arity",
    Arity.RANGE: "arity mismatch: argument count is outside kernel arity range",
    "types": "type mismatch: arguments did not satisfy kernel type_check",
    "options": "options mismatch: options did not satisfy kernel options_check",
    "": "signature accepted",
}
INFERENCE = {
    "arity": "cannot infer result type: invalid arity",
    "types": "cannot infer result type: argument type_check failed",
    "options": "cannot infer result type: options_check failed",
    "nothing": "cannot infer result type: no arguments and no result_type_fn",
    "not found": "cannot infer result type: function not found",
    "no kernels": "cannot infer result type: function has no kernels",
    "": "result type inference should succeed",
}
RESOLUTION = {
    "not found": "function not found",
    "no kernels": "function has no registered kernels",
    "minimum": "no kernel matched minimum arity",
    "range": "no kernel matched arity range",
    "exact": "no kernel matched exact arity",
    "arity": "no kernel matched arity",
    "options": "kernel matched args but options were invalid",
    "types": "no kernel matched argument types",
    "": "kernel resolution should succeed",
}


@dataclass(frozen=True)
class Signature:
    arity: int
    most: int | None = None
    variadic: bool = False
    type_check: Callable[[list[Datum]], bool] | None = None
    options_check: Callable[[Options], bool] | None = None
    result_type: Callable[[list[Datum], Options], DataType] | None = None

    @classmethod
    def any(cls, arity: int, **checks) -> Signature:
        return cls(arity, **checks)

    @classmethod
    def at_least(cls, arity: int, **checks) -> Signature:
        return cls(arity, variadic=True, **checks)

    @classmethod
    def range(cls, least: int, most: int, **checks) -> Signature:
        return cls(least, most, True, **checks)

    @classmethod
    def unary(cls, **checks) -> Signature:
        return cls(1, **checks)

    @classmethod
    def binary(cls, **checks) -> Signature:
        return cls(2, **checks)

    @property
    def model(self) -> Arity:
        if not self.variadic:
            return Arity.EXACT
        return Arity.AT_LEAST if self.most is None else Arity.RANGE

    @property
    def valid(self) -> bool:
        return self.most is None or self.variadic and self.most >= self.arity

    def fails(self, args: list[Datum], options: Options) -> str:
        """The first thing that doesn't fit: "arity", "types", "options", or nothing."""
        most = self.arity if not self.variadic else self.most
        if len(args) < self.arity or most is not None and len(args) > most:
            return "arity"
        if self.type_check and not self.type_check(args):
            return "types"
        if self.options_check and not self.options_check(options):
            return "options"
        return ""

    def accepts(self, args: list[Datum], options: Options = NoOptions()) -> bool:
        return not self.fails(args, options)

    def explain(self, args: list[Datum], options: Options = NoOptions()) -> str:
        what = self.fails(args, options)
        return MISMATCH[self.model if what == "arity" else what]

    def infer(self, args: list[Datum], options: Options = NoOptions()) -> DataType:
        if what := self.fails(args, options):
            raise named({"arity": "InvalidArity", "types": "NoMatchingKernel", "options": "InvalidOptions"}[what])
        if self.result_type:
            return self.result_type(args, options)
        if not args:
            raise named("InvalidInput", "no arguments to take the type from")
        return args[0].data_type

    def explain_inference(self, args: list[Datum], options: Options = NoOptions()) -> str:
        what = self.fails(args, options)
        if not what and not args and not self.result_type:
            what = "nothing"
        return INFERENCE[what]


@dataclass(frozen=True)
class Lifecycle:
    """A mergeable aggregate: init() a state, update(state, batch), merge(state, state), finalize(state)."""

    init: Callable[[], Any]
    update: Callable[[Any, Any], Any]
    merge: Callable[[Any, Any], Any]
    finalize: Callable[[Any], Any]


@dataclass(frozen=True, eq=False)
class Kernel:
    signature: Signature
    run: Callable[[Context, list[Datum], Options], Any]
    lifecycle: Lifecycle | None = None


@dataclass
class Function:
    name: str
    kind: Kind
    kernels: list[Kernel] = field(default_factory=list)


class Registry:
    def __init__(self):
        self._functions: dict[Kind, dict[str, Function]] = {k: {} for k in Kind}

    def register(self, kind: Kind, name: str, kernel: Kernel) -> None:
        if not kernel.signature.valid:
            raise named("InvalidInput", "arity model")
        self._functions[kind].setdefault(name, Function(name, kind)).kernels.append(kernel)

    def scalar(self, name: str, kernel: Kernel) -> None:
        self.register(Kind.SCALAR, name, kernel)

    def vector(self, name: str, kernel: Kernel) -> None:
        self.register(Kind.VECTOR, name, kernel)

    def aggregate(self, name: str, kernel: Kernel) -> None:
        self.register(Kind.AGGREGATE, name, kernel)

    # Introspection.
    def find(self, name: str, kind: Kind) -> Function | None:
        return self._functions[kind].get(name)

    def contains(self, name: str, kind: Kind) -> bool:
        return name in self._functions[kind]

    def all(self) -> list[Function]:
        return [f for kind in Kind for f in self._functions[kind].values()]

    def function_count(self) -> int:
        return len(self.all())

    def function_at(self, index: int) -> Function | None:
        found = self.all()
        return found[index] if 0 <= index < len(found) else None

    def kernel_count(self, name: str, kind: Kind) -> int:
        f = self.find(name, kind)
        return len(f.kernels) if f else 0

    # Resolution.
    def resolve(self, name: str, kind: Kind, args: Sequence[Datum], options: Options = NoOptions()) -> Kernel:
        """The most specific overload that fits; of equals the first registered."""
        f = self.find(name, kind)
        if f is None:
            raise named("FunctionNotFound", name)
        failures = {k: k.signature.fails(list(args), options) for k in f.kernels}
        fitting = [k for k, what in failures.items() if not what]
        if fitting:
            return max(fitting, key=lambda k: k.signature.model.value)
        reasons = set(failures.values())
        if reasons <= {"arity"}:
            raise named("InvalidArity", self.explain(name, kind, args, options))
        raise named("InvalidOptions" if "options" in reasons else "NoMatchingKernel", self.explain(name, kind, args, options))

    def explain(self, name: str, kind: Kind, args: Sequence[Datum], options: Options = NoOptions()) -> str:
        f = self.find(name, kind)
        if f is None:
            return RESOLUTION["not found"]
        if not f.kernels:
            return RESOLUTION["no kernels"]
        signatures = [k.signature for k in f.kernels]
        reasons = {s.fails(list(args), options) for s in signatures}
        for what in ("", "options", "types"):
            if what in reasons:
                return RESOLUTION[what]
        models = {s.model for s in signatures}
        if Arity.AT_LEAST in models and any(len(args) < s.arity for s in signatures):
            return RESOLUTION["minimum"]
        if Arity.RANGE in models:
            return RESOLUTION["range"]
        return RESOLUTION["exact" if Arity.EXACT in models else "arity"]

    def result_type(self, name: str, kind: Kind, args: Sequence[Datum], options: Options = NoOptions()) -> DataType:
        return self.resolve(name, kind, args, options).signature.infer(list(args), options)

    def explain_result_type(self, name: str, kind: Kind, args: Sequence[Datum], options: Options = NoOptions()) -> str:
        f = self.find(name, kind)
        if f is None or not f.kernels:
            return INFERENCE["not found" if f is None else "no kernels"]
        for k in f.kernels:
            if k.signature.accepts(list(args), options):
                return k.signature.explain_inference(list(args), options)
        return self.explain(name, kind, args, options)


@dataclass
class Context:
    """A registry with the engine's defaults; calls resolve, infer, then build."""

    registry: Registry
    config: EngineConfig = EngineConfig()

    def invoke(self, name: str, kind: Kind, args: Sequence[Datum], options: Options = NoOptions()) -> Any:
        kernel = self.registry.resolve(name, kind, args, options)
        kernel.signature.infer(list(args), options)
        return kernel.run(self, list(args), options)

    def scalar(self, name: str, args: Sequence[Datum], options: Options = NoOptions()) -> Any:
        return self.invoke(name, Kind.SCALAR, args, options)

    def vector(self, name: str, args: Sequence[Datum], options: Options = NoOptions()) -> Any:
        return self.invoke(name, Kind.VECTOR, args, options)

    def aggregate(self, name: str, args: Sequence[Datum], options: Options = NoOptions()) -> Any:
        return self.invoke(name, Kind.AGGREGATE, args, options)

    def begin(self, name: str, args: Sequence[Datum], options: Options = NoOptions()):
        from tessel.operators.aggregate import Session

        kernel = self.registry.resolve(name, Kind.AGGREGATE, args, options)
        if kernel.lifecycle is None:
            raise named("MissingLifecycle", name)
        return Session(kernel, options)

    def supports_lifecycle(self, name: str, args: Sequence[Datum], options: Options = NoOptions()) -> bool:
        return self.registry.resolve(name, Kind.AGGREGATE, args, options).lifecycle is not None
