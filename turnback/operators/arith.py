"""Reversible arithmetic: add, sub, mul, div, phase_decomp."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnback.functions.scalars import floor_div, true_div

from .base import Elementwise, Op


def unusable(t: Column) -> Column:
    """Nothing can be derived from this: null, NaN or infinite."""
    d = t.cast("double")
    return t.isNull() | F.isnan(d) | d.isin(float("inf"), float("-inf"))


class _Binary(Elementwise):
    """Keeps the operand ``keep`` (b unless told otherwise), or nothing if that one is a constant; and the other operand
    as ``missing`` where it can't be derived."""

    ins = ("a", "b")

    @property
    def kept(self) -> str:
        return next(iter(self.bound), self.params.get("keep", "b"))

    @property
    def other(self) -> str:
        return "a" if self.kept == "b" else "b"

    @property
    def outs(self) -> tuple[str, ...]:
        return ("target", "missing") if self.bound else ("target", "kept", "missing")

    def saved(self, x: dict[str, Column]) -> Column:
        return x[self.kept] if self.kept in x else x["kept"]

    def _pair(self, got: Column, x: dict[str, Column]) -> dict[str, Column]:
        return {self.kept: self.saved(x), self.other: got}

    def lost(self, t: Column) -> Column:
        return unusable(t)

    def _out(self, t: Column, a: Column, b: Column) -> dict[str, Column]:
        kept, other = (a, b) if self.kept == "a" else (b, a)
        return {"target": t, "kept": kept, "missing": F.when(self.lost(t) | unusable(kept), other)}


class Add(_Binary):
    name = "add"

    def fwd(self, a, b):
        return self._out(a + b, a, b)

    def inv(self, **x):
        s, t = self.saved(x), x["target"]
        return self._pair(F.when(self.lost(t) | unusable(s), x["missing"]).otherwise(t - s), x)


class Sub(_Binary):
    name = "sub"

    def fwd(self, a, b):
        return self._out(a - b, a, b)

    def inv(self, **x):
        s, t = self.saved(x), x["target"]
        return self._pair(F.when(self.lost(t) | unusable(s), x["missing"]).otherwise(s - t if self.kept == "a" else t + s), x)


class Mul(_Binary):
    """``missing`` also holds the factor lost where the product is zero."""

    name = "mul"

    def lost(self, t):
        return unusable(t) | (t == 0)

    def fwd(self, a, b):
        return self._out(a * b, a, b)

    def inv(self, **x):
        s, t = self.saved(x), x["target"]
        return self._pair(F.when(self.lost(t) | unusable(s), x["missing"]).otherwise(t / F.when(s == 0, None).otherwise(s)), x)


class Div(_Binary):
    """Whole numbers (``whole=True``): quotient rounded down, ``remainder`` with the divisor's sign, zero divisors raise.
    Otherwise x/0 is a signed infinity or NaN, and ``missing`` holds the dividend where the quotient isn't finite. With
    the dividend kept, ``missing`` holds the divisor where the quotient is zero too, or (whole) always, as rounding
    loses it."""

    name = "div"

    @property
    def whole(self) -> bool:
        return bool(self.params.get("whole"))

    @property
    def outs(self):
        return (*super().outs, "remainder") if self.whole else super().outs

    def lost(self, t):
        if self.kept == "a":
            return F.lit(True) if self.whole else unusable(t) | (t == 0)
        return unusable(t)

    def fwd(self, a, b):
        if self.whole:
            q, r = floor_div(a, b)
            return self._out(q, a, b) | {"remainder": r}
        return self._out(true_div(a, b), a, b)

    def inv(self, **x):
        s, t = self.saved(x), x["target"]
        if self.kept == "a":
            got = x["missing"] if self.whole else s / F.when(t == 0, None).otherwise(t)
        else:
            got = t * s + x["remainder"] if self.whole else t * s
        return self._pair(F.when(self.lost(t) | unusable(s), x["missing"]).otherwise(got), x)


class PhaseDecomp(Op):
    """Phases of ``a`` under the frequencies ``w``: target = a*w mod 1 in [0, 1), div = floor(a*w), one element for
    each frequency. The inverse takes the largest non-zero frequency; if there is none, a is kept in ``missing``."""

    name = "phase_decomp"
    ins = ("a",)

    @property
    def freqs(self) -> list[float]:
        return [float(w) for w in self.params["freqs"]]

    @property
    def outs(self):
        return ("target", "div") if any(self.freqs) else ("target", "div", "missing")

    def forward(self, cols):
        a = self.args(cols)["a"]
        w = F.array(*map(F.lit, self.freqs))
        return {"target": F.transform(w, lambda x: a * x - F.floor(a * x)), "div": F.transform(w, lambda x: F.floor(a * x).cast("double")), "missing": a}

    def inverse(self, cols):
        w = self.freqs
        if not any(w):
            return {"a": cols["missing"]}
        i = max(range(len(w)), key=lambda k: abs(w[k]))
        return {"a": (F.element_at(cols["target"], i + 1) + F.element_at(cols["div"], i + 1)) / F.lit(w[i])}
