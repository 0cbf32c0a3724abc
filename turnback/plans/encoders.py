"""Encoders: fit on a DataFrame, then encode columns and decode them again.

An encoder names its outputs ``<name>/<what>/<column>`` (``/`` is legal between backticks). ``fit`` gives a model, an
immutable description that saves as JSON; ``forward`` replaces the encoded columns by the outputs, ``inverse`` does the
opposite. Numeric, datetime, categorical and Fourier fits contribute expressions to one aggregation.
"""

from __future__ import annotations

import json
import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import reduce as fold
from itertools import accumulate
from pathlib import Path
from typing import Any, ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DataType, IntegerType, StringType, StructField, StructType

from turnback.functions import tokens as T
from turnback.functions.diff import patch, script
from turnback.functions.lots import by_lot, lots
from turnback.functions.scalars import missing
from turnback.operators import make
from turnback.operators.encode import hot

from .stats import Stats, shift_scale

UNK = "[UNK]"
#: distinct tokens that a task counts before it passes them on
MANY = 500_000
KINDS: dict[str, type[Encoder]] = {}


def col(name: str) -> Column:
    return F.col(f"`{name}`")


@dataclass
class Encoder:
    """``state`` is None until fitted."""

    name: str
    cols: list[str]
    state: dict | None = field(default=None, kw_only=True)
    kind: ClassVar[str] = ""
    norms: ClassVar[tuple] = (None, "mean_std", "min_max")

    def __init_subclass__(cls) -> None:
        KINDS[cls.kind] = cls

    def check(self) -> None:
        """Raise on parameters that make no sense."""
        if not self.cols:
            raise ValueError("an encoder needs columns")
        if getattr(self, "norm", None) not in self.norms:
            raise ValueError(f"norm {self.norm!r}: one of {self.norms}")

    def __len__(self) -> int:
        return len(self.cols)

    def out(self, what: str, c: str) -> str:
        return f"{self.name}/{what}/{c}"

    # fitting: expressions for one aggregation, and what their row means

    def fit_exprs(self, df: DataFrame) -> list[Column]:
        return []

    def fit_state(self, row: Any, df: DataFrame) -> dict:
        return {}

    def fit(self, df: DataFrame) -> Encoder:
        self.check()
        lacking = [c for c in self.cols if c not in df.columns]
        if lacking:
            raise ValueError(f"no columns {lacking}")
        exprs = self.fit_exprs(df)
        row = df.agg(*exprs).first() if exprs else None
        return self.fitted(self.fit_state(row, df))

    def fit_batches(self, batches: Iterable[DataFrame]) -> Encoder:
        """Fit on an iterator of DataFrames: one aggregation each where fits can be merged, else one over all of them."""
        frames = iter(batches)
        if hasattr(self, "merge") and getattr(self, "fill", None) not in FILLS:
            return fold(lambda a, b: a.merge(b), (self.fit(df) for df in frames))
        return self.fit(fold(DataFrame.unionByName, frames))

    def forward_batches(self, batches: Iterable[DataFrame]) -> Iterator[DataFrame]:
        """``forward`` of each DataFrame of an iterator, when it is asked for."""
        return map(self.forward, batches)

    def fitted(self, state: dict) -> Encoder:
        new = type(self)(**{k: v for k, v in self.params().items()})
        new.state = state
        return new

    def params(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "state"}

    def need(self) -> dict:
        if self.state is None:
            raise ValueError(f"{self.name} isn't fitted")
        return self.state

    # running

    def encode(self) -> dict[str, Column]:
        raise NotImplementedError

    def decode(self) -> dict[str, Column]:
        raise NotImplementedError

    def forward(self, df: DataFrame) -> DataFrame:
        self.need()
        rest = [c for c in df.columns if c not in self.cols]
        return df.select(*map(col, rest), *(e.alias(n) for n, e in self.encode().items()))

    def inverse(self, df: DataFrame) -> DataFrame:
        self.need()
        outs = set(self.encode())
        rest = [c for c in df.columns if c not in outs]
        return df.select(*map(col, rest), *(e.alias(n) for n, e in self.decode().items()))

    def schema(self, df: DataFrame) -> StructType:
        """The fields that ``forward`` makes of ``df``'s columns."""
        outs = set(self.encode())
        return StructType([f for f in self.forward(df.limit(0)).schema if f.name in outs])

    def ddl(self, var_lim: int = 255) -> dict[str, str]:
        """SQL types of the decoded columns."""
        return dict.fromkeys(self.cols, "FLOAT")

    def create_table(self, table: str, var_lim: int = 255) -> str:
        cols = ", ".join(f'"{c}" {t}' for c, t in self.ddl(var_lim).items())
        return f'CREATE TABLE "{table}" (example_id INTEGER PRIMARY KEY, {cols})'

    def default_rows(self, spark: SparkSession, n: int) -> DataFrame:
        """n rows of the types' defaults."""
        zero = {"FLOAT": F.lit(0.0), "INTEGER": F.lit(0), "BOOLEAN": F.lit(False), "TIMESTAMP": F.to_timestamp_ntz(F.lit("1970-01-01"))}
        return spark.range(n).select(*(zero.get(t, F.lit("")).alias(c) for c, t in self.ddl().items()))

    # files

    def to_dict(self) -> dict:
        return {"kind": self.kind, "params": self.params(), "state": self.state}

    @staticmethod
    def from_dict(d: dict) -> Encoder:
        e = KINDS[d["kind"]](**d["params"])
        e.state = d["state"]
        return e

    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(self.to_dict()))

    @staticmethod
    def load(path: str) -> Encoder:
        return Encoder.from_dict(json.loads(Path(path).read_text()))


#: fills by name: an aggregate of the values that are there
FILLS: dict[str, Callable[[Column], Column]] = {
    "median": lambda c: F.percentile_approx(c, 0.5, 10_000),
    "mode": lambda c: F.mode(c, True),
}


def register_fill(name: str, fn: Callable[[Column], Column]) -> str:
    """Make an aggregate of a column's values available as the ``fill`` of an encoder; it is part of the fit's one aggregation."""
    FILLS[name] = fn
    return name


class _Scaled(Encoder):
    """Numbers shifted and scaled by column (axis 0), by row (axis 1), or all together (axis None)."""

    kind = ""

    def number(self, c: str) -> tuple[Column, Column]:
        """The column as a number and whether it's missing."""
        raise NotImplementedError

    def filling(self, s: Stats) -> float:
        f = self.fill
        if isinstance(f, str):
            if not s.n:
                return 0.0
            return {"min": s.low, "max": s.high, "mean": s.mean}[f]
        return float(f)

    def check(self) -> None:
        super().check()
        if self.axis not in (0, 1, None):
            raise ValueError(f"axis {self.axis!r}: 0, 1 or None")
        if isinstance(self.fill, str) and self.fill not in ("min", "max", "mean", *FILLS):
            raise ValueError(f"fill {self.fill!r}: a number, min, max, mean or a registered one ({sorted(FILLS)})")

    def fit_exprs(self, df):
        out = []
        for i, c in enumerate(self.cols):
            v, gone = self.number(c)
            out += Stats.exprs(v, gone, f"{self.name}__{i}")
            if self.fill in FILLS:
                out.append(FILLS[self.fill](F.when(~gone, v.cast("double"))).cast("double").alias(f"{self.name}__{i}_fill"))
        return out

    def fit_state(self, row, df):
        each = [Stats.of(row, f"{self.name}__{i}") for i in range(len(self.cols))]
        if self.fill in FILLS:
            return self.state_of(each, [row[f"{self.name}__{i}_fill"] or 0.0 for i in range(len(self.cols))])
        return self.state_of(each)

    def state_of(self, each: list[Stats], fills: list[float] | None = None) -> dict:
        fills = fills or [self.filling(s) for s in each]
        full = [s.filled(f) for s, f in zip(each, fills)]
        if self.axis is None:
            full = [sum(full, Stats())] * len(full)
        pairs = [shift_scale(s, self.norm if self.axis != 1 else None) for s in full]
        return {"fill": fills, "shift": [p[0] for p in pairs], "scale": [p[1] for p in pairs], "stats": [list(s.__dict__.values()) for s in each]}

    def merge(self, other: _Scaled) -> _Scaled:
        """The model of both fits' data together. A registered fill can't be had from two fits."""
        if self.fill in FILLS:
            raise ValueError(f"fill {self.fill!r} needs all rows at once")
        each = [Stats(*a) + Stats(*b) for a, b in zip(self.need()["stats"], other.need()["stats"])]
        return self.fitted(self.state_of(each))

    def scaled(self) -> dict[str, Column]:
        s = self.need()
        full = {}
        for i, c in enumerate(self.cols):
            v, gone = self.number(c)
            full[c] = F.when(gone, F.lit(s["fill"][i])).otherwise(v.cast("double"))
        if self.axis != 1 or self.norm is None:
            return {c: (v - F.lit(s["shift"][i])) / F.lit(s["scale"][i]) for i, (c, v) in enumerate(full.items())}
        low, scale = self._row(list(full.values()))
        return {c: (v - low) / scale for c, v in full.items()}

    def _row(self, vs: list[Column]) -> tuple[Column, Column]:
        n = len(vs)
        if self.norm == "mean_std":
            low = sum(vs[1:], vs[0]) / n
            scale = F.sqrt(sum(((v - low) * (v - low) for v in vs[1:]), (vs[0] - low) * (vs[0] - low)) / n)
        else:
            low = F.least(*vs) if n > 1 else vs[0]
            scale = (F.greatest(*vs) if n > 1 else vs[0]) - low
        return low, F.when(scale == 0, F.lit(1.0)).otherwise(scale)

    def row_outputs(self) -> dict[str, Column]:
        """By row, the shift and scale are data: they are outputs too."""
        if self.axis != 1 or self.norm is None:
            return {}
        s = self.need()
        vs = [F.when(self.number(c)[1], F.lit(s["fill"][i])).otherwise(self.number(c)[0].cast("double")) for i, c in enumerate(self.cols)]
        low, scale = self._row(vs)
        return {f"{self.name}/row/shift": low, f"{self.name}/row/scale": scale}

    def unscaled(self, i: int, c: str) -> Column:
        s = self.need()
        if self.axis == 1 and self.norm:
            return col(self.out("nums", c)) * col(f"{self.name}/row/scale") + col(f"{self.name}/row/shift")
        return col(self.out("nums", c)) * F.lit(s["scale"][i]) + F.lit(s["shift"][i])


@dataclass
class Numeric(_Scaled):
    """Outputs nums, nans, and was_null where both NULL and NaN mean missing. ``exact`` keeps the column itself."""

    norm: str | None = None
    axis: int | None = 0
    fill: float | str = 0.0
    exact: bool = False
    kind = "numeric"

    def number(self, c):
        v = col(c).cast("double")
        return v, missing(v)

    def encode(self):
        out = {self.out("nums", c): v for c, v in self.scaled().items()}
        out |= {self.out("nans", c): missing(col(c).cast("double")) for c in self.cols}
        out |= {self.out("was_null", c): col(c).isNull() for c in self.cols}
        if self.exact:
            out |= {self.out("exact", c): col(c) for c in self.cols}
        return out | self.row_outputs()

    def decode(self):
        if self.exact:
            return {c: col(self.out("exact", c)) for c in self.cols}
        return {c: F.when(col(self.out("was_null", c)), F.lit(None)).when(col(self.out("nans", c)), F.lit(float("nan"))).otherwise(self.unscaled(i, c)) for i, c in enumerate(self.cols)}


@dataclass
class Datetime(_Scaled):
    """Outputs nums, nats and diff (microseconds); exact to the microsecond."""

    norm: str | None = None
    axis: int | None = 0
    fill: float | str = 0.0
    unit: str = "D"
    num_units: int = 1
    zero: str = "1970-01-01 00:00:00"
    kind = "datetime"

    def op(self):
        return make("datetime_to_num", unit=self.unit, num_units=self.num_units, zero=self.zero)

    def check(self):
        super().check()
        self.op()

    def number(self, c):
        return self.op().forward({"a": col(c)})["target"], col(c).isNull()

    def encode(self):
        out = {self.out("nums", c): v for c, v in self.scaled().items()}
        out |= {self.out("nats", c): col(c).isNull() for c in self.cols}
        out |= {self.out("diff", c): F.coalesce(self.op().forward({"a": col(c)})["diff"], F.lit(0).cast("long")) for c in self.cols}
        return out | self.row_outputs()

    def decode(self):
        back = {}
        for i, c in enumerate(self.cols):
            t = self.op().inverse({"target": self.unscaled(i, c), "diff": col(self.out("diff", c))})["a"]
            back[c] = F.when(~col(self.out("nats", c)), t)
        return back

    def ddl(self, var_lim=255):
        return dict.fromkeys(self.cols, "TIMESTAMP")


@dataclass
class Categorical(Encoder):
    """Outputs indices (-1: unknown), missing_vals and one_hots, scaled by mean and std with ``norm='mean_std'``.

    The mean of a one-hot is its category's share p and its variance p(1 - p): counts are all that is fitted.
    """

    categories: list = field(default_factory=list)
    norm: str | None = None
    kind = "categorical"
    norms = (None, "mean_std")

    def check(self):
        super().check()
        if not self.categories or len(set(self.categories)) != len(self.categories):
            raise ValueError("categories are needed, each once")

    def fit_exprs(self, df):
        if self.norm is None:
            return []
        ops = {c: self._op().forward({"cats": col(c)})["target"] for c in self.cols}
        e = [F.count(F.lit(1)).alias(f"{self.name}__n")]
        return e + [F.count_if(i == k).alias(f"{self.name}__{j}_{k}") for j, i in enumerate(ops.values()) for k in range(len(self.categories))]

    def fit_state(self, row, df):
        if self.norm is None:
            return {"p": None}
        n = max(1, row[f"{self.name}__n"])
        return {"p": [[row[f"{self.name}__{j}_{k}"] / n for k in range(len(self.categories))] for j in range(len(self.cols))]}

    def _op(self):
        return make("cat_to_index", values=self.categories)

    def encode(self):
        out = {}
        p = self.need()["p"]
        for j, c in enumerate(self.cols):
            got = self._op().forward({"cats": col(c)})
            out[self.out("indices", c)] = got["target"]
            out[self.out("missing_vals", c)] = got["missing"]
            one = hot(got["target"], len(self.categories))
            if p:
                means = F.array(*(F.lit(float(x)) for x in p[j]))
                stds = F.array(*(F.lit(math.sqrt(x * (1 - x)) or 1.0) for x in p[j]))
                one = F.transform(one, lambda v, i: (v - F.get(means, i)) / F.get(stds, i))  # noqa: B023
            out[self.out("one_hots", c)] = one
        return out

    def decode(self):
        return {c: self._op().inverse({"target": col(self.out("indices", c)), "missing": col(self.out("missing_vals", c))})["cats"] for c in self.cols}

    def ddl(self, var_lim=255):
        text = all(isinstance(v, str) for v in self.categories)
        return dict.fromkeys(self.cols, f"VARCHAR({max(map(len, self.categories))})" if text else "FLOAT")


class _Text(Encoder):
    """What the one-language and the many-language encoders share.

    A column is encoded, decoded and counted in one Python function each, some rows at a time. Texts of a language (None
    for the encoder of one) have its tokenizer, detokenizer and words.
    """

    kind = ""

    def _steps(self) -> list[str]:
        return [what for flag, what in ((self.lower, "lower_case"), (self.half, "half_width"), (self.lemmatizer, "lemmatize")) if flag]

    def _struct(self) -> StructType:
        words, text = ArrayType(StringType()), StringType()
        return StructType([StructField("tokenize_diff", text), *(StructField(f"{k}_diff", text) for k in self._steps()), StructField("indices", ArrayType(IntegerType())), StructField("missing_vals", words)])

    def _normals(self) -> list[Callable[[list[str]], list[str]]]:
        """The steps, on the tokens of a row."""
        lemma = T.REGISTRY[self.lemmatizer] if self.lemmatizer else None
        fns = {
            "lower_case": lambda ts: _rejoined(ts, str.lower),
            "half_width": lambda ts: ts if all(map(str.isascii, ts)) else [unicodedata.normalize("NFKC", t) for t in ts],
            "lemmatize": lambda ts: [lemma(t) if t else t for t in ts],
        }
        return [fns[k] for k in self._steps()]

    def _encode(self, c: str, lang: Column | None, tokenizers: dict, detokenizers: dict, words: dict) -> dict[str, Column]:
        cut, back, normals, kind = {k: T.REGISTRY[t] for k, t in tokenizers.items()}, {k: T.REGISTRY[t] for k, t in detokenizers.items()}, self._normals(), self._struct()
        index, n, to = {k: {w: i for i, w in reversed(list(enumerate(v)))} for k, v in words.items()}, self.max_len, to_arrow_type(kind)

        def rows(texts: pa.Array, langs: pa.Array) -> pa.Array:
            diffs: list[list] = [[] for _ in range(len(normals) + 1)]
            ends, indices, rest = [0], [], []
            for s, k in zip(texts.to_pylist(), langs.to_pylist()):
                if k not in cut:
                    raise ValueError(f"no tokenizer for language {k}")
                cur = [] if s is None else cut[k](s)
                cur = cur if n is None else [*cur[:n], *[""] * (n - len(cur))]
                diffs[0].append(script(back[k](cur), s))
                for fn, out in zip(normals, diffs[1:]):
                    new = fn(cur)
                    out.append("[]" if new is cur else script("\x1f".join(new), "\x1f".join(cur)))
                    cur = new
                at = index[k]
                found = [-1 if t == "" else at.get(t, 0) for t in cur]
                indices += found
                rest += ["" if i else t for i, t in zip(found, cur)]
                ends.append(len(indices))
            off = pa.array(ends, pa.int32())
            lists = [pa.ListArray.from_arrays(off, pa.array(indices, pa.int32())), pa.ListArray.from_arrays(off, pa.array(rest, pa.string()))]
            return pa.StructArray.from_arrays([*(pa.array(d, pa.string()) for d in diffs), *lists], fields=list(to))

        got = _by_language(rows, kind)(col(c), lang)
        return {self.out(f.name, c): got[f.name] for f in kind}

    def _decode(self, c: str, lang: Column | None, detokenizers: dict, words: dict) -> Column:
        back = {k: T.REGISTRY[t] for k, t in detokenizers.items()}
        every = pa.array([w for v in words.values() for w in v], pa.string())
        first = dict(zip(words, accumulate((len(v) for v in words.values()), initial=0)))

        def rows(indices: pa.Array, rest: pa.Array, *more: pa.Array) -> pa.Array:
            *diffs, langs = (x.to_pylist() for x in more)
            i, sizes = indices.flatten(), pc.fill_null(pc.list_value_length(indices), 0)
            start = np.repeat(np.array([first.get(k, 0) for k in langs], np.int64), sizes.to_numpy(zero_copy_only=False))
            word = every.take(pa.array(np.where(i.to_numpy() > 0, i.to_numpy() + start, 0)))
            cur = pc.if_else(pc.equal(i, 0), rest.flatten(), pc.if_else(pc.less(i, 0), "", word))
            off = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
            out = []
            for k, joined, *edits in zip(langs, pc.binary_join(pa.ListArray.from_arrays(off, cur), "\x1f").to_pylist(), *diffs):
                if k not in back or None in edits:
                    out.append(None)
                    continue
                for e in edits[:0:-1]:
                    joined = patch(joined, e)
                out.append(patch(back[k](joined.split("\x1f")), edits[0]))
            return pa.array(out, pa.string())

        names = ["indices", "missing_vals", "tokenize_diff", *(f"{k}_diff" for k in self._steps())]
        return _by_language(rows, StringType())(*(col(self.out(k, c)) for k in names), lang)

    def _counts(self, df: DataFrame, lang: str | None, tokenizers: dict) -> DataFrame:
        """lang, token, n: how often each token occurs, as parts that are to be added."""
        cut, normals = {k: T.REGISTRY[t] for k, t in tokenizers.items()}, self._normals()

        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: dict[Any, Counter] = defaultdict(Counter)

            def out() -> Iterator[pa.RecordBatch]:
                for k, n in seen.items():
                    yield pa.RecordBatch.from_arrays([pa.array([k] * len(n), pa.string()), pa.array(n, pa.string()), pa.array(n.values(), pa.int64())], ["lang", "token", "n"])
                seen.clear()

            for batch in batches:
                *texts, langs = batch.columns
                for x in texts:
                    for part in lots(x, langs):
                        for s, k in zip(*(y.to_pylist() for y in part)):
                            if k not in cut:
                                raise ValueError(f"no tokenizer for language {k}")
                            ts = [] if s is None else cut[k](s)
                            for fn in normals:
                                ts = fn(ts)
                            seen[k].update(ts)
                        if sum(map(len, seen.values())) > MANY:
                            yield from out()
            yield from out()

        texts = self.cols if lang is None else [c for c in self.cols if c != lang]
        return df.select(*map(col, texts), (F.lit(None).cast("string") if lang is None else col(lang)).alias("__lang")).mapInArrow(parts, "lang string, token string, n bigint")

    def check(self):
        super().check()
        if not self.vocab and not self.max_vocab:
            raise ValueError("vocab or max_vocab is needed")

    def ddl(self, var_lim=255):
        return dict.fromkeys(self.cols, f"VARCHAR({var_lim})")


def _rejoined(ts: list[str], fn: Callable[[str], str]) -> list[str]:
    """A function that leaves characters apart, on all tokens at once; the list itself if nothing changes."""
    whole = "\x1f".join(ts)
    new = fn(whole)
    if new == whole:
        return ts
    got = new.split("\x1f")
    return got if len(got) == len(ts) else [fn(t) for t in ts]  # a token that holds the separator


def _by_language(rows: Callable[..., pa.Array], kind: DataType) -> Callable[..., Column]:
    """A column of Arrow arrays, the last of them the language (None: of none)."""
    one = F.arrow_udf(lambda *cols: by_lot(rows, *cols), kind)
    plain = F.arrow_udf(lambda *cols: by_lot(rows, *cols, pa.nulls(len(cols[0]), pa.string())), kind)
    return lambda *cols: plain(*cols[:-1]) if cols[-1] is None else one(*cols)


def top_words(words: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k most frequent ``token``s (for each ``by``), ties in order of token. Counts first, so only they are sorted."""
    return top_counts(words.groupBy(*by, "token").agg(F.count("*").alias("n")), by, k)


def top_counts(n: DataFrame, by: list[str], k: int) -> DataFrame:
    """:func:`top_words` of ``token``s with their counts ``n``."""
    if not by:
        return n.orderBy(F.col("n").desc(), "token").limit(k)
    return n.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.col("n").desc(), "token"))).filter(F.col("r") <= k).drop("r")


@dataclass
class Text(_Text):
    """Outputs indices (-1 padding, 0 unknown), missing_vals, tokenize_diff and, as asked, lower_case_diff,
    half_width_diff, lemmatize_diff. The vocabulary counts all tokens; ``max_vocab`` bounds it, [UNK] included."""

    max_len: int = 20
    tokenizer: str = "whitespace"
    detokenizer: str = "join"
    vocab: list | None = None
    max_vocab: int | None = None
    lower: bool = False
    half: bool = False
    lemmatizer: str | None = None
    kind = "text"
    norms = (None,)

    def fit_state(self, row, df):
        if self.vocab:
            return {"words": list(self.vocab)}
        n = self._counts(df, None, {None: self.tokenizer}).groupBy("token").agg(F.sum("n").alias("n"))
        got = top_counts(n, [], self.max_vocab - 1).collect()  # max_vocab rows at most
        return {"words": [UNK, *sorted(r["token"] for r in got)]}

    def encode(self):
        words = {None: self.need()["words"]}
        out = {}
        for c in self.cols:
            out |= self._encode(c, None, {None: self.tokenizer}, {None: self.detokenizer}, words)
        return out

    def decode(self):
        return {c: self._decode(c, None, {None: self.detokenizer}, {None: self.need()["words"]}) for c in self.cols}


@dataclass
class Multilingual(_Text):
    """Two columns: text and language. Everything is by language: tokenizers, detokenizers, vocabularies. A language
    without a tokenizer raises. Outputs as :class:`Text`, and languages."""

    tokenizers: dict = field(default_factory=dict)
    detokenizers: dict = field(default_factory=dict)
    max_len: int = 20
    vocab: dict | None = None
    max_vocab: int | None = None
    lower: bool = False
    half: bool = False
    lemmatizer: str | None = None
    kind = "multilingual"
    norms = (None,)

    def check(self):
        super().check()
        if len(self.cols) != 2:
            raise ValueError("a text and a language column are needed")
        if self.vocab and any(v[0] != UNK for v in self.vocab.values()):
            raise ValueError(f"vocabularies start with {UNK}")

    def fit_state(self, row, df):
        if self.vocab:
            return {"words": self.vocab}
        n = self._counts(df, self.cols[1], self.tokenizers).groupBy("lang", "token").agg(F.sum("n").alias("n"))
        found: dict[str, list[str]] = {k: [] for k in self.tokenizers}
        for r in top_counts(n, ["lang"], self.max_vocab - 1).collect():  # max_vocab rows a language at most
            found[r["lang"]].append(r["token"])
        return {"words": {k: [UNK, *sorted(v)] for k, v in found.items()}}

    def encode(self):
        text, lang = self.cols
        return self._encode(text, col(lang), self.tokenizers, self.detokenizers, self.need()["words"]) | {self.out("languages", lang): col(lang)}

    def decode(self):
        text, lang = self.cols[0], col(self.out("languages", self.cols[1]))
        return {text: self._decode(text, lang, self.detokenizers, self.need()["words"]), self.cols[1]: lang}


@dataclass
class Fourier(Encoder):
    """Two columns: time and amplitude. Fits X_k = mean(amp e^(-2 pi i k t)), t in [0, 1] from ``zero`` to ``end``, for k
    below ``frequencies``; encodes t by its phases under the ``top`` strongest. Outputs nums, div, amps, nats, diff."""

    zero: str = "1970-01-01 00:00:00"
    end: str = ""
    frequencies: int = 3
    top: int | None = None
    kind = "fourier"
    norms = (None,)

    def check(self):
        super().check()
        if len(self.cols) != 2 or not self.end:
            raise ValueError("a time and an amplitude column and an end are needed")
        if self.top is not None and self.top > self.frequencies:
            raise ValueError("top can't exceed frequencies")

    def _op(self):
        return make("datetime_to_num", unit="us", zero=self.zero)

    def _span(self) -> Column:
        return F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit(self.zero)), F.to_timestamp_ntz(F.lit(self.end))).cast("double")

    def _t(self) -> Column:
        return F.coalesce(self._op().forward({"a": col(self.cols[0])})["target"] / self._span(), F.lit(0.0))

    def fit_exprs(self, df):
        amp = col(self.cols[1]).cast("double")
        amp = F.when(missing(amp), F.lit(0.0)).otherwise(amp)
        out = []
        for k in range(self.frequencies):
            a = F.lit(2 * math.pi * k) * self._t()
            out += [F.avg(amp * F.cos(a)).alias(f"{self.name}__re{k}"), F.avg(-amp * F.sin(a)).alias(f"{self.name}__im{k}")]
        return out

    def fit_state(self, row, df):
        x = [(row[f"{self.name}__re{k}"] or 0.0, row[f"{self.name}__im{k}"] or 0.0) for k in range(self.frequencies)]
        order = sorted(range(self.frequencies), key=lambda k: (-round(math.hypot(*x[k]), 12), k))
        return {"coefficients": x, "order": order[: self.top or self.frequencies]}

    def _phase(self):
        return make("phase_decomp", freqs=[float(k) for k in self.need()["order"]])

    def encode(self):
        t, a = self.cols
        op = self._phase()
        got = op.forward({"a": self._t()})
        out = {self.out("nums", t): got["target"], self.out("div", t): got["div"], self.out("amps", a): col(a), self.out("nats", t): col(t).isNull()}
        out[self.out("diff", t)] = F.coalesce(self._op().forward({"a": col(t)})["diff"], F.lit(0).cast("long"))
        if "missing" in op.outs:
            out[self.out("t", t)] = got["missing"]
        return out

    def decode(self):
        t, a = self.cols
        back = self._phase().inverse({"target": col(self.out("nums", t)), "div": col(self.out("div", t)), "missing": col(self.out("t", t))} if "missing" in self._phase().outs else {"target": col(self.out("nums", t)), "div": col(self.out("div", t))})["a"]
        when = self._op().inverse({"target": back * self._span(), "diff": col(self.out("diff", t))})["a"]
        return {t: F.when(~col(self.out("nats", t)), when), a: col(self.out("amps", a))}

    def ddl(self, var_lim=255):
        return {self.cols[0]: "TIMESTAMP", self.cols[1]: "FLOAT"}


@dataclass
class Dataset(Encoder):
    """Routes columns to encoders. All aggregate fits are one aggregation, all encodings one projection; columns may
    feed several encoders, and every column given must feed one."""

    children: list = field(default_factory=list)
    kind = "dataset"
    norms = (None,)

    def __post_init__(self):
        self.children = [c if isinstance(c, Encoder) else Encoder.from_dict(c) for c in self.children]

    def add(self, child: Encoder) -> Dataset:
        if any(c.name == child.name for c in self.children):
            raise ValueError(f"encoder {child.name!r} is there already")
        child.check()
        self.children.append(child)
        return self

    def check(self):
        super().check()
        unused = [c for c in self.cols if not any(c in e.cols for e in self.children)]
        if unused:
            raise ValueError(f"no encoder uses {unused}")

    def params(self):
        return {"name": self.name, "cols": self.cols, "children": [c.to_dict() for c in self.children]}

    def fit(self, df):
        self.check()
        exprs = [e for c in self.children for e in c.fit_exprs(df)]
        row = df.agg(*exprs).first() if exprs else None
        fitted = [c.fitted(c.fit_state(row, df)) for c in self.children]
        new = Dataset(self.name, self.cols, fitted)
        new.state = {}
        return new

    def encode(self):
        return {f"{self.name}/{n}": e for c in self.children for n, e in c.encode().items()}

    def inverse(self, df):
        outs = self.encode()
        rest = [c for c in df.columns if c not in outs]
        plain = df.select(*map(col, rest), *(col(n).alias(n[len(self.name) + 1 :]) for n in outs))
        back: dict[str, Column] = {}
        for c in self.children:
            back |= {k: v for k, v in c.decode().items() if k not in back}
        return plain.select(*map(col, rest), *(back[k].alias(k) for k in self.cols))

    def ddl(self, var_lim=255):
        out: dict[str, str] = {}
        for c in self.children:
            out |= {k: v for k, v in c.ddl(var_lim).items() if k not in out}
        return {k: out[k] for k in self.cols}


def ddl_frame(spark: SparkSession, e: Encoder, var_lim: int = 255) -> DataFrame:
    return spark.createDataFrame(list(e.ddl(var_lim).items()), "column string, type string")
