"""Reversible row-local operators.

An operator has named inputs and outputs. ``forward`` maps input columns to output columns, ``inverse`` maps the outputs
back to the inputs; both are plain expressions, so whole graphs collapse into one projection. Outputs besides the
result are residuals: just what the inverse can't derive. An input bound to a constant needs none.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import Any, ClassVar

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnback.functions.scalars import nested

OPS: dict[str, type[Op]] = {}


class Op:
    name: ClassVar[str] = ""
    ins: ClassVar[tuple[str, ...]] = ()

    def __init__(self, bound: dict[str, Any] | None = None, depth: int = 0, **params: Any):
        self.bound, self.depth, self.params = dict(bound or {}), depth, params
        unknown = set(self.bound) - set(self.inputs)
        if unknown:
            raise ValueError(f"{self.name} has no input {sorted(unknown)}")

    def __init_subclass__(cls) -> None:
        if cls.name:
            OPS[cls.name] = cls

    @property
    def inputs(self) -> tuple[str, ...]:
        return self.ins

    @property
    def free(self) -> tuple[str, ...]:
        """The inputs that aren't constants."""
        return tuple(i for i in self.inputs if i not in self.bound)

    @property
    def outs(self) -> tuple[str, ...]:
        raise NotImplementedError

    def args(self, cols: dict[str, Column]) -> dict[str, Column]:
        return {i: F.lit(self.bound[i]) if i in self.bound else cols[i] for i in self.inputs}

    def forward(self, cols: dict[str, Column]) -> dict[str, Column]:
        raise NotImplementedError

    def inverse(self, cols: dict[str, Column]) -> dict[str, Column]:
        raise NotImplementedError


class Elementwise(Op):
    """An operator given on scalars and applied to the elements of arrays nested ``depth`` deep."""

    def fwd(self, **x: Column) -> dict[str, Column]:
        raise NotImplementedError

    def inv(self, **x: Column) -> dict[str, Column]:
        raise NotImplementedError

    def _each(self, fn: Callable[..., dict[str, Column]], x: dict[str, Column], want: tuple[str, ...]) -> dict[str, Column]:
        names = list(x)
        flat = frozenset(i for i, n in enumerate(names) if n in self.bound)
        return {o: nested(lambda *a: fn(**dict(zip(names, a)))[o], self.depth, list(x.values()), flat) for o in want}  # noqa: B023

    def forward(self, cols: dict[str, Column]) -> dict[str, Column]:
        return self._each(self.fwd, self.args(cols), self.outs)

    def inverse(self, cols: dict[str, Column]) -> dict[str, Column]:
        x = {o: cols[o] for o in self.outs} | {i: F.lit(v) for i, v in self.bound.items()}
        return self._each(self.inv, x, self.free)


def make(name: str, bound: dict[str, Any] | None = None, **params: Any) -> Op:
    """An operator by name."""
    if name not in OPS:
        raise ValueError(f"no operator {name!r}; there are {sorted(OPS)}")
    return OPS[name](bound, **params)
