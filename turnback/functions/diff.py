"""Edit scripts between strings: JSON lists of [tag, from, to, text], tag d (delete) or i (insert or replace).

The difference of short texts is taken with difflib. Longer ones of equal length that agree in most places list those
that differ; those of as many words list the words and spaces that differ; both take time in proportion to the length.
The rest is difflib's, between the common head and tail, which beyond ``LIMIT`` characters is replaced as a whole, as
difflib's time grows with the square of the length. The script is exact in all cases.
"""

from __future__ import annotations

import difflib
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .lots import by_lot

LIMIT = 4_000
SHORT = 256
_WORD = re.compile(r"(\S+)")


def _by_word(source: str, target: str) -> list[list] | None:
    """The words and spaces that differ; None unless the texts have as many words."""
    a, b = _WORD.split(source), _WORD.split(target)  # space, word, space, ..., word, space
    if len(a) != len(b):
        return None
    ops, at = [], 0
    for x, y in zip(a, b):
        if x != y:
            ops.append(["i" if y else "d", at, at + len(x), y])
        at += len(x)
    return ops


def script(source: str | None, target: str | None) -> str | None:
    """What turns ``source`` into ``target``; None if either is."""
    if source is None or target is None:
        return None
    if source == target:
        return "[]"
    ops = []
    if len(source) == len(target) > SHORT:
        same = np.frombuffer(source.encode("utf-32-le", "surrogatepass"), np.uint32) == np.frombuffer(target.encode("utf-32-le", "surrogatepass"), np.uint32)
        if 2 * int(same.sum()) >= len(source):  # the places that differ
            edge = np.flatnonzero(np.diff(np.concatenate([[True], same, [True]])))
            return json.dumps([["i", i, j, target[i:j]] for i, j in zip(edge[::2].tolist(), edge[1::2].tolist())])
    head = 0
    if max(len(source), len(target)) > SHORT:
        ops = _by_word(source, target)
        if ops is not None:
            return json.dumps(ops)
        ops = []  # what longer texts have in common at their ends needs no comparison
        head = len(os.path.commonprefix([source, target]))
        tail = len(os.path.commonprefix([source[head:][::-1], target[head:][::-1]]))
        source, target = source[head : len(source) - tail], target[head : len(target) - tail]
    if max(len(source), len(target)) > LIMIT or not source or not target:
        if source or target:
            ops.append(["i" if target else "d", head, head + len(source), target])
    else:
        for tag, i, j, k, m in difflib.SequenceMatcher(None, source, target).get_opcodes():
            if tag != "equal":
                ops.append(["d" if tag == "delete" else "i", head + i, head + j, target[k:m] if tag != "delete" else ""])
    return json.dumps(ops)


def patch(source: str | None, edits: str | None) -> str | None:
    """``source`` with an edit script applied."""
    if source is None or edits is None:
        return source
    out, at = [], 0
    for tag, i, j, text in json.loads(edits):
        out += [source[at:i], text if tag == "i" else ""]
        at = j
    return "".join([*out, source[at:]])


@F.arrow_udf(StringType())
def _script(source: pa.Array, target: pa.Array) -> pa.Array:
    return by_lot(lambda a, b: pa.array(map(script, a.to_pylist(), b.to_pylist()), pa.string()), source, target)


@F.arrow_udf(StringType())
def _patch(source: pa.Array, edits: pa.Array) -> pa.Array:
    return by_lot(lambda a, b: pa.array(map(patch, a.to_pylist(), b.to_pylist()), pa.string()), source, edits)


def script_col(source: Column, target: Column) -> Column:
    """Edit scripts, with no Python call where the strings are equal."""
    changed = source != target
    s = F.when(changed, source)
    return F.when(changed, _script(s, F.when(changed, target))).when(source.isNotNull() & target.isNotNull(), F.lit("[]"))


def patch_col(source: Column, edits: Column) -> Column:
    """A null script stands for a null."""
    changed = edits != "[]"
    return F.when(changed, _patch(F.when(changed, source), F.when(changed, edits))).when(edits == "[]", source)
