"""Predicates. Their residuals are their inputs, which the inverse returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnback.functions.scalars import missing, ordered
from turnback.functions.tokens import lookup

from .base import Elementwise


class Lifted(Elementwise):
    """A function of columns as an operator: its inverse gives the inputs back."""

    fn: Callable[..., Column]

    @property
    def outs(self):
        return ("target", *self.free)

    def fwd(self, **x):
        return {"target": type(self).fn(self, *(x[i] for i in self.inputs)), **{i: x[i] for i in self.free}}

    def inv(self, **x):
        return {i: x[i] for i in self.free}


def lift(op_name: str, fn: Callable[..., Column], *ins: str) -> type[Lifted]:
    """Register ``fn`` (columns to a column) as an operator with a trivial inverse."""
    return type(op_name.title().replace("_", ""), (Lifted,), {"name": op_name, "ins": ins, "fn": lambda self, *a: fn(*a)})


IsNan = lift("isnan", missing, "a")
IsNat = lift("isnat", lambda a: a.isNull(), "a")
Greater = lift("greater", ordered(lambda a, b: a > b), "a", "b")
GreaterEqual = lift("greater_equal", ordered(lambda a, b: a >= b), "a", "b")
Less = lift("less", ordered(lambda a, b: a < b), "a", "b")
LessEqual = lift("less_equal", ordered(lambda a, b: a <= b), "a", "b")


class Equals(Lifted):
    """Equality. NaN equals nothing; pass ``floating=False`` for strings and other types without NaN."""

    name = "equals"
    ins = ("a", "b")

    def fn(self, a, b):
        if self.params.get("floating", True):
            return ordered(lambda x, y: x == y)(a, b)
        return F.coalesce(a == b, F.lit(False))


class IsIn(Lifted):
    """Membership in the list ``values``."""

    name = "isin"
    ins = ("a",)

    def fn(self, a):
        values = list(self.params["values"])
        return lookup(a, values) >= 0 if values else F.lit(False)


class MultiIsIn(Lifted):
    """Membership in the list that ``selector`` chooses from ``values`` (a dict of lists)."""

    name = "multi_isin"
    ins = ("a", "selector")

    def fn(self, a, selector):
        out = F.lit(False)
        for key, values in self.params["values"].items():
            out = F.when(selector == F.lit(key), lookup(a, list(values)) >= 0).otherwise(out)
        return out


class LogicalNot(Elementwise):
    name = "logical_not"
    ins = ("a",)
    outs = ("target",)

    def fwd(self, a):
        return {"target": ~a}

    def inv(self, target):
        return {"a": ~target}
