"""Arrow batches a slice at a time: Python objects of some rows only, however many the batch holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa

#: Bytes of the columns of a slice.
SLICE_BYTES = 1 << 20


def slices(columns: tuple[pa.Array, ...]) -> Iterator[tuple[pa.Array, ...]]:
    """Consecutive rows of the columns, of ``SLICE_BYTES`` at most where a row isn't larger."""
    waiting = [columns]
    while waiting:
        part = waiting.pop()
        rows = len(part[0])
        if rows > 1 and sum(c.nbytes for c in part) > SLICE_BYTES:
            half = rows // 2
            waiting += [tuple(c.slice(half) for c in part), tuple(c.slice(0, half) for c in part)]
        elif rows:
            yield part


def by_slices(batches: Iterator, of: Callable[..., list], kind: pa.DataType) -> Iterator[pa.Array]:
    """For Arrow functions over one column or several: an array of ``kind`` for each batch, from the values that ``of`` makes of each slice."""
    for batch in batches:
        columns = batch if isinstance(batch, tuple) else (batch,)
        made = [pa.array(of(*part), kind) for part in slices(columns)]
        del batch, columns  # before the next one is read
        yield pa.concat_arrays(made) if made else pa.array([], kind)
        del made
