"""Arrow batches in slices of bounded size: a task's Python holds a slice's rows and results, not those of a batch of thousands."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Bytes of payload in a slice; a row that is larger is a slice of its own.
SLICE = 1 << 20


def slices(batches: Iterable[pa.RecordBatch], *columns: str, most: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batches' rows in order, cut so that ``columns`` hold ``most`` bytes at most."""
    for batch in batches:
        sizes = sum(pc.fill_null(pc.binary_length(batch.column(c)), 0).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
        ends, at = np.cumsum(sizes), 0
        while at < batch.num_rows:
            stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def id_type(frame: DataFrame) -> str:
    return frame.schema["stream_id"].dataType.simpleString()
