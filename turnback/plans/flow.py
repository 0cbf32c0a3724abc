"""Graphs of operators that run forward and, by themselves, backward.

    flow = Flow()
    x, y = flow.input("x"), flow.input("y")
    out = (x - 3.0) / y
    flow.name(out, "scaled")
    done = flow.forward(df)      # df with the flow's outputs instead of x and y
    back = flow.inverse(done)    # x and y again

Ports that no operator consumes are outputs. A port used several times is its own clone: the inverse takes it from
whichever consumer has it. Every step is a column expression; Catalyst sees one projection.
"""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnback.operators import Op, make


class Port:
    """An output of a node, or an input of the flow."""

    def __init__(self, flow: Flow, node: str, key: str):
        self.flow, self.node, self.key = flow, node, key

    @property
    def ref(self) -> str:
        return f"{self.node}/{self.key}"

    def _op(self, name: str, a: Any, b: Any) -> Port:
        return self.flow.add(name, a=a, b=b)["target"]

    def __add__(self, o): return self._op("add", self, o)  # noqa: E704
    def __radd__(self, o): return self._op("add", o, self)  # noqa: E704
    def __sub__(self, o): return self._op("sub", self, o)  # noqa: E704
    def __rsub__(self, o): return self._op("sub", o, self)  # noqa: E704
    def __mul__(self, o): return self._op("mul", self, o)  # noqa: E704
    def __rmul__(self, o): return self._op("mul", o, self)  # noqa: E704
    def __truediv__(self, o): return self._op("div", self, o)  # noqa: E704
    def __rtruediv__(self, o): return self._op("div", o, self)  # noqa: E704


class Flow:
    def __init__(self, prefix: str = ""):
        self.prefix = prefix
        self.inputs: list[str] = []
        self.nodes: dict[str, tuple[Op, dict[str, str]]] = {}
        self.names: dict[str, str] = {}
        self.plugs: dict[str, Any] = {}
        self._counts: dict[str, int] = {}
        self._specs: list[dict] = []

    # building

    def input(self, name: str) -> Port:
        if name in self.inputs:
            raise ValueError(f"input {name!r} is there already")
        self.inputs.append(name)
        return Port(self, "input", name)

    def add(self, op: str, node: str | None = None, depth: int = 0, **given: Any) -> dict[str, Port]:
        """An operator. Its inputs are ports, lists of ports or constants; everything else is a parameter."""
        probe = make(op, depth=depth, **{k: v for k, v in given.items() if not isinstance(v, Port)} | ({"n": 0} if "n" not in given else {}))
        ports = {k: v for k, v in given.items() if isinstance(v, Port)}
        bound = {k: v for k, v in given.items() if k in probe.inputs and not isinstance(v, Port)}
        params = {k: v for k, v in given.items() if k not in ports and k not in bound}
        for k, v in [*params.items(), *bound.items()]:
            if isinstance(v, list) and v and all(isinstance(x, Port) for x in v):
                ports[k] = self.add("port_list", n=len(v), **{f"a{i}": p for i, p in enumerate(v)})["target"]
                params.pop(k, None)
                bound.pop(k, None)
        made = make(op, bound, depth=depth, **params)
        lacking = set(made.free) - set(ports)
        if lacking or set(ports) - set(made.free):
            raise ValueError(f"{op}: its inputs are {made.free}, given were {sorted(ports)}")
        if node is None:
            i = self._counts.get(op, 0)
            self._counts[op] = i + 1
            node = f"{op}_{i}"
        if node in self.nodes or node == "input":
            raise ValueError(f"node {node!r} is there already")
        self.nodes[node] = (made, {k: p.ref for k, p in ports.items()})
        self._specs.append({"op": op, "node": node, "depth": depth, "bound": bound, "params": params, "inputs": {k: p.ref for k, p in ports.items()}})
        return {o: Port(self, node, o) for o in made.outs}

    def name(self, port: Port, name: str) -> Port:
        """The column name of an output."""
        if name in self.names.values():
            raise ValueError(f"name {name!r} is there already")
        self.names[port.ref] = name
        return port

    def plug(self, name: str, value: Any) -> None:
        """A value for an input (by name) or an output (by column name) that a DataFrame lacks: a constant, or a function of
        a dict of columns. A column of that name goes first."""
        if name not in self.inputs and name not in self.outputs.values():
            raise ValueError(f"{name!r} is no input and no output")
        self.plugs[name] = value

    def unplug(self, name: str) -> None:
        """Take back a :meth:`plug`."""
        if name not in self.plugs:
            raise ValueError(f"nothing is plugged into {name!r}")
        del self.plugs[name]

    # structure

    def _consumers(self) -> dict[str, list[tuple[str, str]]]:
        used: dict[str, list[tuple[str, str]]] = {}
        for node, (_, ins) in self.nodes.items():
            for key, ref in ins.items():
                used.setdefault(ref, []).append((node, key))
        return used

    @property
    def outputs(self) -> dict[str, str]:
        """Output port -> column name."""
        used = self._consumers()
        refs = [f"input/{i}" for i in self.inputs if f"input/{i}" not in used]
        refs += [f"{n}/{o}" for n, (op, _) in self.nodes.items() for o in op.outs if f"{n}/{o}" not in used]
        return {r: self.prefix + self.names.get(r, r) for r in refs}

    # running

    def forward(self, df: DataFrame, keep: list[str] | None = None, plugs: dict[str, Any] | None = None) -> DataFrame:
        """``df`` with the flow's input columns replaced by its outputs. ``plugs`` are constants, or functions of a dict of
        columns, for inputs that aren't columns of ``df``."""
        plugs = {k: v for k, v in self.plugs.items() if k in self.inputs and k not in df.columns} | (plugs or {})
        lacking = [i for i in self.inputs if i not in df.columns and i not in plugs]
        if lacking:
            raise ValueError(f"inputs without a column: {lacking}")
        if clash := [i for i in plugs if i in df.columns or i not in self.inputs]:
            raise ValueError(f"plugged inputs are columns too, or unknown: {clash}")
        have: dict[str, Column] = {f"input/{i}": F.col(f"`{i}`") for i in self.inputs if i not in plugs}
        for i, v in plugs.items():
            have[f"input/{i}"] = v(dict(have)) if callable(v) else F.lit(v)
        rest = [c for c in (df.columns if keep is None else keep) if c not in self.inputs]
        for k, (node, (op, ins)) in enumerate(self.nodes.items()):
            got = op.forward({key: have[ref] for key, ref in ins.items()})
            tmp = {f"__{k}_{o}": got[o] for o in op.outs}
            df = df.withColumns(tmp)
            have |= {f"{node}/{o}": F.col(f"__{k}_{o}") for o in op.outs}
        return df.select(*[F.col(f"`{c}`") for c in rest], *[have[r].alias(n) for r, n in self.outputs.items()])

    def inverse(self, df: DataFrame, plugs: dict[str, Any] | None = None) -> DataFrame:
        """The inputs from a DataFrame with the flow's outputs; other columns stay. ``plugs`` are constants, or functions of
        a dict of columns by name, for outputs that aren't columns of ``df``."""
        outs = self.outputs
        plugs = {k: v for k, v in self.plugs.items() if k in outs.values() and k not in df.columns} | (plugs or {})
        if clash := [n for n in plugs if n in df.columns or n not in outs.values()]:
            raise ValueError(f"plugged outputs are columns too, or unknown: {clash}")
        there = {n: F.col(f"`{n}`") for n in outs.values() if n in df.columns}
        df = df.withColumns({n: v(dict(there)) if callable(v) else F.lit(v) for n, v in plugs.items()}) if plugs else df
        lacking = [n for n in outs.values() if n not in df.columns]
        if lacking:
            raise ValueError(f"outputs without a column: {lacking}")
        rest = [c for c in df.columns if c not in outs.values()]
        have: dict[str, Column] = {r: F.col(f"`{n}`") for r, n in outs.items()}
        for k, (node, (op, ins)) in reversed(list(enumerate(self.nodes.items()))):
            got = op.inverse({o: have[f"{node}/{o}"] for o in op.outs})
            need = {key: ref for key, ref in ins.items() if ref not in have}
            df = df.withColumns({f"__{k}_{key}": got[key] for key in need})
            have |= {ref: F.col(f"__{k}_{key}") for key, ref in need.items()}
        return df.select(*[F.col(f"`{c}`") for c in rest], *[have[f"input/{i}"].alias(i) for i in self.inputs])

    # files

    def to_json(self) -> str:
        """The graph. Callables appear by their registered names."""
        return json.dumps({"prefix": self.prefix, "inputs": self.inputs, "nodes": self._specs, "names": self.names}, indent=1)

    @classmethod
    def from_json(cls, text: str) -> Flow:
        d = json.loads(text)
        flow = cls(d["prefix"])
        ports = {f"input/{i}": flow.input(i) for i in d["inputs"]}
        for s in d["nodes"]:
            made = flow.add(s["op"], s["node"], s["depth"], **s["params"], **s["bound"], **{k: ports[r] for k, r in s["inputs"].items()})
            ports |= {p.ref: p for p in made.values()}
            kind, _, number = s["node"].rpartition("_")
            if kind == s["op"] and number.isdigit():
                flow._counts[kind] = max(flow._counts.get(kind, 0), int(number) + 1)
        flow.names = d["names"]
        return flow

    def save(self, path: str) -> None:
        Path(path).write_text(self.to_json())

    @classmethod
    def load(cls, path: str) -> Flow:
        return cls.from_json(Path(path).read_text())
