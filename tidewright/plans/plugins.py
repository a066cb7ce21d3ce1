"""Plugins by kind: what a plugin must offer, and the registry that holds them."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Contract:
    """``requires``: methods that must be there; ``stateful``: the plugin is a factory whose
    product is checked after it is made."""

    kind: str
    purpose: str
    requires: tuple[str, ...]
    optional: tuple[str, ...] = ()
    stateful: bool = False

    def problems(self, impl: Any, made: bool = False) -> list[str]:
        out = [] if isinstance(getattr(impl, "id", None), str) or made else ["id must be text"]
        wanted = ("create",) if self.stateful and not made else self.requires
        return out + [f"{self.kind} needs {m}()" for m in wanted if not callable(getattr(impl, m, None))]

    def describe(self) -> str:
        return f"{self.kind}: {self.purpose}; needs {', '.join(self.requires)}" + (f"; may have {', '.join(self.optional)}" if self.optional else "")


CONTRACTS = {
    c.kind: c
    for c in (
        Contract("source", "reads bars or rows into a DataFrame", ("read",), ("schema",)),
        Contract("feature", "a causal Column over a stream's bars", ("column",), ("params",)),
        Contract("label", "adds outcomes to bars", ("label",)),
        Contract("learner", "fits on one fold and predicts the next", ("fit", "predict"), ("state",), True),
        Contract("memory", "keeps prototypes between batches", ("insert", "retrieve"), ("decay",), True),
        Contract("retrieve", "finds candidates for a query", ("candidates",)),
        Contract("risk", "turns a signal into a position", ("position",), ("apply_to_weights",)),
        Contract("sleeve", "turns a panel into weights and returns", ("signal", "returns"), ("earn_times",)),
        Contract("book", "composes sleeves", ("compose",)),
        Contract("evaluator", "scores net returns", ("evaluate",)),
    )
}


@dataclass
class Entry:
    impl: Any
    state: str = "UNTESTED"
    default: bool = False
    capability: dict = field(default_factory=dict)


class Registry:
    """Plugins under (kind, id)."""

    def __init__(self) -> None:
        self._by: dict[str, dict[str, Entry]] = {k: {} for k in CONTRACTS}

    def register(self, kind: str, impl: Any, state: str = "UNTESTED", default: bool = False, replace: bool = False) -> None:
        bad = self.contract(kind).problems(impl)
        if bad:
            raise TypeError("; ".join(bad))
        if impl.id in self._by[kind] and not replace:
            raise ValueError(f"{kind} {impl.id} is there already")
        self._by[kind][impl.id] = Entry(impl, state, default, getattr(impl, "capability", {}))

    def contract(self, kind: str) -> Contract:
        if kind not in CONTRACTS:
            raise KeyError(f"no kind {kind}")
        return CONTRACTS[kind]

    def has(self, kind: str, ident: str) -> bool:
        return ident in self._by.get(kind, {})

    def resolve(self, kind: str, ident: str) -> Any:
        if not self.has(kind, ident):
            raise KeyError(f"no {kind} {ident}")
        return self._by[kind][ident].impl

    def resolve_or_none(self, kind: str, ident: str) -> Any | None:
        return self._by[kind][ident].impl if self.has(kind, ident) else None

    def ids(self, kind: str) -> list[str]:
        return sorted(self._by[kind])

    def entries(self, kind: str) -> list[Entry]:
        return [self._by[kind][i] for i in self.ids(kind)]

    def capability_of(self, kind: str, ident: str) -> dict:
        return self._by[kind][ident].capability

    def state_of(self, kind: str, ident: str) -> str:
        return self._by[kind][ident].state

    def instantiate(self, kind: str, ident: str, **options: Any) -> Any:
        contract, impl = self.contract(kind), self.resolve(kind, ident)
        if not contract.stateful:
            return impl
        made = impl.create(**options)
        bad = contract.problems(made, made=True)
        if bad:
            raise TypeError("; ".join(bad))
        return made

    def kinds(self) -> list[str]:
        return sorted(k for k, v in self._by.items() if v)

    def active_roster(self, kind: str) -> list[str]:
        return [i for i in self.ids(kind) if self._by[kind][i].default]

    def stack_digest(self) -> str:
        return fingerprint({k: self.active_roster(k) for k in self.kinds()})

    def report(self, spark: SparkSession) -> DataFrame:
        rows = [(k, i, e.state, e.default) for k in self.kinds() for i, e in sorted(self._by[k].items())]
        return spark.createDataFrame(rows, "kind string, id string, state string, active boolean")

    def reset(self) -> None:
        self.__init__()


def canonical(value: Any) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), default=str)


def fnv1a(text: str) -> int:
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 & 0xFFFFFFFF
    return h


def fingerprint(value: Any) -> str:
    return f"{fnv1a(canonical(value)):08x}"


def content_digest(value: Any) -> str:
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def function_plugin(ident: str, method: str, f: Callable) -> Any:
    """A plugin of one function."""
    return type("FunctionPlugin", (), {"id": ident, method: staticmethod(f)})()


def default_registry() -> Registry:
    """The shipped features, learners and risk rules."""
    from tidewright.operators import learners
    from tidewright.operators.features import FEATURES, clamp_position

    r = Registry()
    for n, f in FEATURES.items():
        r.register("feature", function_plugin(n, "column", f), "TESTED", True)
    for cls in learners.LEARNERS.values():
        r.register("learner", cls, "TESTED", cls.id != "attention")
    r.register("risk", function_plugin("clamp", "position", clamp_position), "TESTED", True)
    return r
