"""Arrow batches of bounded text."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that become Python strings at a time.
TEXT_BYTES = 4_000_000


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, in slices of less than ``most`` bytes of a text column after the slice's first text. A
    list counts eight bytes an entry."""
    most = TEXT_BYTES if most is None else most
    for batch in batches:
        of = batch.column(column)
        sizes = pc.list_value_length(of) if pa.types.is_list(of.type) else pc.binary_length(of)
        size = pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64) * (8 if pa.types.is_list(of.type) else 1)
        part = np.cumsum(size) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts, cuts[1:]):
            if end > start:
                yield batch.slice(start, end - start)
