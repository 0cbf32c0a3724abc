"""Casts and times as numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from turnback.functions.scalars import UNIT_US, micros_since

from .base import Elementwise

_WHOLE = {"int", "bigint", "long", "smallint", "tinyint", "integer"}


class Cast(Elementwise):
    """``dtype`` of a value. ``diff`` is what truncation toward zero (or truth) loses; values that the type can't hold
    (NaN, infinities, text that isn't a number) become null and stay in ``missing``."""

    name = "cast"
    ins = ("a",)

    @property
    def outs(self):
        return ("target", "diff", "missing") if self.params.get("source", "double") in ("double", "float") else ("target", "missing")

    def fwd(self, a):
        to, frm = self.params["dtype"], self.params.get("source", "double")
        if frm in ("double", "float"):
            ok = ~(F.isnan(a) | a.isin(float("inf"), float("-inf"))) if to in _WHOLE or to == "boolean" else a.isNotNull()
            t = F.when(ok, a).cast(to)
            back = t.cast("int").cast("double") if to == "boolean" else t.cast("double")
            return {"target": t, "diff": F.when(ok, a - back), "missing": F.when(~ok, a)}
        t = a.try_cast(to)
        return {"target": t, "missing": F.when(t.isNull() | (t.cast(frm) != a), a)}

    def inv(self, **x):
        frm, to = self.params.get("source", "double"), self.params["dtype"]
        if "diff" in x:
            back = x["target"].cast("int").cast("double") if to == "boolean" else x["target"].cast("double")
            return {"a": F.coalesce(x["missing"], (back + x["diff"]).cast(frm))}
        return {"a": F.coalesce(x["missing"], x["target"].cast(frm))}


class DatetimeToNum(Elementwise):
    """Time since ``zero`` in steps of ``num_units`` ``unit``s as a number, and in ``diff`` the microseconds left when the
    number of whole units is dropped. The inverse is exact, also after the number went through float scaling."""

    name = "datetime_to_num"
    ins = ("a",)
    outs = ("target", "diff")

    def __init__(self, *a, **k):
        super().__init__(*a, **k)
        unit = self.params.get("unit", "D")
        if unit in ("Y", "M"):
            raise ValueError("years and months have no fixed length")
        if unit not in UNIT_US:
            raise ValueError(f"unit {unit!r}: one of {sorted(UNIT_US)}")
        self.unit_us, self.n = UNIT_US[unit], self.params.get("num_units", 1)

    @property
    def zero(self):
        return F.to_timestamp_ntz(F.lit(str(self.params.get("zero", "1970-01-01 00:00:00"))))

    def fwd(self, a):
        us = micros_since(a, self.zero)
        return {"target": us / F.lit(float(self.n * self.unit_us)), "diff": us - self._whole(us) * F.lit(self.unit_us)}

    def _whole(self, us):
        whole = F.floor(F.abs(us) / F.lit(self.unit_us))  # toward zero
        return F.when(us < 0, -whole).otherwise(whole)

    def inv(self, target, diff):
        k = F.round((target * F.lit(float(self.n * self.unit_us)) - diff) / F.lit(float(self.unit_us))).cast("long")
        return {"a": F.timestamp_add("MICROSECOND", k * F.lit(self.unit_us) + diff, self.zero)}
