"""Few rows at a time for UDFs over pages: a batch holds up to ten thousand, whose results would all be in a worker's memory at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd

SLICE = 128


def slices(batches: Iterable[tuple[pd.Series, ...]]) -> Iterator[tuple[pd.Series, ...]]:
    """The same rows in the same order; an iterator UDF may give a batch's results in several parts."""
    for columns in batches:
        for i in range(0, len(columns[0]), SLICE):
            yield tuple(c.iloc[i : i + SLICE] for c in columns)
