"""Documents in contiguous id ranges, streamed in id order within each."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a range, about; ranges at most (beyond, they hold more rows: a range is streamed); sampled ids a range.
ROWS, RANGES, SAMPLED = 8192, 200_000, 32


def ranges_of(rows: int) -> int:
    """How many ranges so many rows are dealt to."""
    return min(RANGES, max(1, rows // ROWS))


def id_bounds(docs: DataFrame) -> np.ndarray:
    """Upper ends (exclusive) of all id ranges but the last, ascending, by a sample of ids (SAMPLED a range, by hash).

    Only ids are read, and only the sample comes to the driver.
    """
    ids = docs.select("doc_id").where("doc_id is not null")
    total = ids.count()
    ranges = ranges_of(total)
    if ranges == 1:
        return np.zeros(0, np.int64)
    bound = -(1 << 63) + int(min(1.0, SAMPLED * ranges / total) * ((1 << 64) - 1))
    found = np.sort(np.asarray(ids.where(F.xxhash64("doc_id") <= F.lit(min(bound, (1 << 63) - 1))).distinct().toArrow().column(0).to_numpy(), np.int64))
    return np.unique(found[np.arange(1, ranges) * len(found) // ranges]) if len(found) else found
