"""Arrow batches worked off a few rows at a time, so that a Python worker never holds a batch as Python objects."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: bytes and rows of a lot
BYTES, ROWS = 1 << 20, 1024


def lots(*cols: pa.Array) -> Iterator[list[pa.Array]]:
    """Slices of equal rows. A lot has about ``BYTES`` by the batch's mean and ``ROWS`` at most."""
    n = len(cols[0])
    step = max(1, min(ROWS, BYTES * n // max(1, sum(c.nbytes for c in cols))))
    for k in range(0, n, step):
        yield [c.slice(k, step) for c in cols]


def by_lot(fn: Callable[..., pa.Array], *cols: pa.Array) -> pa.Array:
    """``fn`` of each lot, put together."""
    done = [fn(*x) for x in lots(*cols)]
    return pa.concat_arrays(done) if done else fn(*cols)
