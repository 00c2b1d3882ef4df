"""Cutting Arrow batches of long texts into parts of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PART_BYTES = 1 << 21
PART_ROWS = 2048


def parts(
    batches: Iterator[pa.RecordBatch], text: str = "text", most_bytes: int = PART_BYTES, most_rows: int = PART_ROWS
) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in turn, in parts of about ``most_bytes`` of text; a longer text is a part alone."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0)
        reached = np.cumsum(np.asarray(sizes, np.int64))
        at = 0
        while at < batch.num_rows:
            before = reached[at - 1] if at else 0
            end = int(np.searchsorted(reached, before + most_bytes, "right"))
            end = min(max(end, at + 1), at + most_rows)
            yield batch.slice(at, end - at)
            at = end
    # workers that Spark uses again give back what batches took
    pa.default_memory_pool().release_unused()


class Recent:
    """A store of values by word in two generations; a new one starts when the young one has ``most``.

    Words met again in a generation stay, others go with the old one. A store lives as long as the task
    that made it, so workers that Spark uses again keep nothing.
    """

    def __init__(self, most: int):
        self.most = most
        self.young: dict = {}
        self.old: dict = {}

    def of(self, words: set, make: Callable[[set], dict]) -> dict:
        """A store with the values of all ``words``; ``make`` gives those of new ones."""
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        missing = words - self.young.keys()
        again = missing & self.old.keys()
        self.young.update((word, self.old[word]) for word in again)
        self.young.update(make(missing - again))
        return self.young
