"""Columns made by Python functions that take a batch a slice at a time.

Spark hands over 10,000 rows at once, whatever their size. What a function makes of texts (pieces, ids) is many times
as large, so a batch is turned into Python values, and its results go out, by about `MOST` bytes; a worker's memory
does not grow with the rows of a batch, but for the batch itself.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of the values of a slice; those of lists (ids) count as four each.
MOST = 1 << 20

_TYPES = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "array<string>": pa.list_(pa.string()), "array<binary>": pa.list_(pa.binary()), "array<int>": pa.list_(pa.int32())}


def slices(values: pa.Array, most: int | None = None) -> Iterator[pa.Array]:
    """The array in runs of rows of about so many bytes; a longer value ends its run."""
    of_list = pa.types.is_list(values.type) or pa.types.is_large_list(values.type)
    length = pc.list_value_length(values) if of_list else pc.binary_length(values)
    size = pc.fill_null(length, 0).to_numpy(zero_copy_only=False).astype(np.int64) * (4 if of_list else 1)
    run = (np.cumsum(size) - size) // (most or MOST)
    edges = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), len(values)]
    return (values.slice(a, z - a) for a, z in zip(edges, edges[1:]))


def _python(part: pa.Array) -> list:
    """The values as Python ones; lists of numbers without a conversion number by number."""
    if not pa.types.is_list(part.type) or part.values.null_count or not pa.types.is_integer(part.type.value_type):
        return part.to_pylist()
    flat, ends = part.values.to_numpy(), part.offsets.to_numpy()
    return [flat[a:z].tolist() if known else None for a, z, known in zip(ends, ends[1:], part.is_valid().to_pylist())]


def python_values(batch: pa.Array) -> Iterator:
    """The Python values of a batch, of which only a slice's are made at once."""
    return (x for part in slices(batch) for x in _python(part))


def column(values, make: Callable[[], Callable], returns: str, arrow: pa.DataType | None = None, pinned: bool = False) -> Column:
    """make()(value) of each value (text, bytes or list), null too; make is called once in a task.

    arrow: the Arrow type of `returns` where it is none of the usual ones. A pinned column stays where it is written.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of = make()
        for batch in batches:
            for part in slices(batch):
                yield pa.array([of(x) for x in _python(part)], arrow or _TYPES[returns])

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(run, returns)
    return (udf.asNondeterministic() if pinned else udf)(values)
