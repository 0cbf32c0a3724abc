"""Tokenizers, detokenizers and lemmatizers by name, so that saved graphs and models can refer to them."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from .lots import by_lot

_SEPARATORS = re.compile("[\x1c-\x1f]")
_SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
_WORDS = re.compile(r"\w+|[^\w\s]")
REGISTRY: dict[str, Callable] = {}


def register(name: str, fn: Callable) -> str:
    """Make a callable available to operators under ``name`` (on the workers too: it is pickled with the plan)."""
    REGISTRY[name] = fn
    return name


# as Java's (?U)\s, which leaves out four control characters that Python splits at
register("whitespace", lambda s: [t for t in _SPACE.split(s) if t] if _SEPARATORS.search(s) else s.split())
register("words", lambda s: _WORDS.findall(s))
register("characters", list)
register("join", lambda toks: " ".join(t for t in toks if t))
register("join_all", " ".join)
register("concat", "".join)
register("plural", lambda w: w[:-1] if len(w) > 3 and w.endswith("s") and not w.endswith("ss") else w)
register("nfkc", lambda s: unicodedata.normalize("NFKC", s))


def _each(kind: str, fn: Callable) -> Callable[[Column], Column]:
    """A Python callable on each value that isn't null."""
    to = pa.list_(pa.string()) if kind == "array<string>" else pa.string()

    @F.arrow_udf(kind)
    def run(s: pa.Array) -> pa.Array:
        return by_lot(lambda x: pa.array([None if v is None else fn(v) for v in x.to_pylist()], to), s)

    return run


def tokens(c: Column, name: str) -> Column:
    """The tokens of a string (null: null). Whitespace and characters are split in the JVM."""
    if name == "whitespace":
        return F.when(c.isNotNull(), F.filter(F.split(c, r"(?U)\s+"), lambda t: t != ""))
    if name == "characters":
        return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(c, ""))
    return _each("array<string>", REGISTRY[name])(c)


def text(c: Column, name: str) -> Column:
    """A string of tokens."""
    if name in ("join", "join_all", "concat"):
        c = F.filter(c, lambda t: t != "") if name == "join" else c
        return F.array_join(c, "" if name == "concat" else " ")
    return _each("string", REGISTRY[name])(c)


def mapped(c: Column, name: str) -> Column:
    """A string-to-string callable."""
    return _each("string", REGISTRY[name])(c)


def fixed(toks: Column, n: int | None) -> Column:
    """Exactly n tokens: cut, or padded with empty strings. Without n, all of them and no padding."""
    toks = F.coalesce(toks, F.array().cast("array<string>"))
    return toks if n is None else F.slice(F.concat(toks, F.array_repeat(F.lit(""), n)), 1, n)


def _index(values: pa.Array, words: pa.Array, start: int, unknown: int) -> pa.Array:
    return pc.fill_null(pc.add(pc.index_in(values, value_set=words), pa.scalar(start, pa.int32())), unknown)


def lookup(c: Column, words: list, start: int = 0, unknown: int = -1) -> Column:
    """Positions of a value in a list. Short lists are CASE expressions, longer ones an Arrow dictionary lookup; the
    list is a parameter of the operator, its size set by whoever made it."""
    if len(words) <= 64:
        out = None
        for i, w in enumerate(words):
            cond = F.isnan(c) if isinstance(w, float) and w != w else c == F.lit(w)
            out = F.when(cond, i + start) if out is None else out.when(cond, i + start)
        return F.lit(unknown) if out is None else out.otherwise(unknown)
    if all(isinstance(w, str) for w in words):
        every = pa.array(words, pa.string())

        @F.arrow_udf("int")
        def find(s: pa.Array) -> pa.Array:
            return _index(s, every, start, unknown)

        return find(c)
    index = {w: i + start for i, w in enumerate(words)}

    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        return s.map(index).fillna(unknown).astype("int32")

    return run(c)


def lookup_array(c: Column, words: list[str], start: int = 0, unknown: int = -1) -> Column:
    """The same for arrays of strings."""
    if len(words) <= 64:
        return F.transform(c, lambda t: lookup(t, words, start, unknown))
    every = pa.array(words, pa.string())

    @F.arrow_udf("array<int>")
    def run(s: pa.Array) -> pa.Array:
        off = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(s), 0).to_numpy(zero_copy_only=False)))
        found = _index(s.flatten(), every, start, unknown)
        return pa.ListArray.from_arrays(pa.array(off, pa.int32()), found, mask=s.is_null() if s.null_count else None)

    return run(c)
