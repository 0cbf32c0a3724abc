"""Dataflow operators: clones, identities, lists and dicts of ports."""

from __future__ import annotations

import logging

from pyspark.sql import functions as F

from .base import Op

log = logging.getLogger("turnback")


class DoNothing(Op):
    name = "do_nothing"
    ins = ("a",)
    outs = ("target",)

    def forward(self, cols):
        return {"target": self.args(cols)["a"]}

    def inverse(self, cols):
        return {"a": cols["target"]}


class CloneMany(Op):
    """The value ``num`` times; the inverse takes the first."""

    name = "clone_many"
    ins = ("a",)

    @property
    def outs(self):
        return tuple(f"t{i}" for i in range(self.params.get("num", 2)))

    def forward(self, cols):
        return dict.fromkeys(self.outs, self.args(cols)["a"])

    def inverse(self, cols):
        return {"a": cols["t0"]}


class Clone(CloneMany):
    """The value twice."""

    name = "clone"


class MergeEqual(Op):
    """Equal values as one; with ``test_equal`` a difference raises."""

    name = "merge_equal"

    @property
    def inputs(self):
        return tuple(f"a{i}" for i in range(self.params["n"]))

    outs = ("target",)

    def forward(self, cols):
        first, *rest = self.args(cols).values()
        if self.params.get("test_equal"):
            same = F.lit(True)
            for r in rest:
                same = same & first.eqNullSafe(r)
            first = F.when(same, first).otherwise(F.raise_error(F.lit("values to be merged differ")))
        return {"target": first}

    def inverse(self, cols):
        return {i: cols["target"] for i in self.free}


class PrintVal(DoNothing):
    """Identity that logs its column in both directions."""

    name = "print_val"

    def forward(self, cols):
        log.info("forward %s", cols)
        return super().forward(cols)

    def inverse(self, cols):
        log.info("inverse %s", cols)
        return super().inverse(cols)


class IterList(Op):
    """An array or the first ``num_entries`` of it as ports."""

    name = "iter_list"
    ins = ("a",)

    def __init__(self, *a, **k):
        super().__init__(*a, **k)
        if "num_entries" not in self.params:
            raise ValueError("num_entries is needed")

    @property
    def outs(self):
        return tuple(f"t{i}" for i in range(self.params["num_entries"]))

    def forward(self, cols):
        a = self.args(cols)["a"]
        return {o: F.get(a, i) for i, o in enumerate(self.outs)}

    def inverse(self, cols):
        return {"a": F.array(*(cols[o] for o in self.outs))}


class IterDict(Op):
    """Named fields of a struct or map as ports; the inverse makes a struct (or, with ``map=True``, a map)."""

    name = "iter_dict"
    ins = ("a",)

    def __init__(self, *a, **k):
        super().__init__(*a, **k)
        if "keys" not in self.params:
            raise ValueError("keys are needed")

    @property
    def outs(self):
        return tuple(self.params["keys"])

    def forward(self, cols):
        a = self.args(cols)["a"]
        return {k: F.try_element_at(a, F.lit(k)) if self.params.get("map") else a[k] for k in self.outs}

    def inverse(self, cols):
        if self.params.get("map"):
            return {"a": F.create_map(*(x for k in self.outs for x in (F.lit(k), cols[k])))}
        return {"a": F.struct(*(cols[k].alias(k) for k in self.outs))}


class PortList(Op):
    """Ports as an array."""

    name = "port_list"

    @property
    def inputs(self):
        return tuple(f"a{i}" for i in range(self.params["n"]))

    outs = ("target",)

    def forward(self, cols):
        return {"target": F.array(*self.args(cols).values())}

    def inverse(self, cols):
        return {i: F.get(cols["target"], k) for k, i in enumerate(self.inputs) if i in self.free}
