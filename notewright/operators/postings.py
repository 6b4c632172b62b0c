"""Word lists of sessions to posting lists, on Arrow batches inside tasks."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle

# Functions that run in tasks travel with their code, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def posting_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of (block, number, held) to (block, word, numbers); a block's rows are all in one task."""
    parts = list(batches)
    if not parts:
        return
    table = pa.Table.from_batches(parts).combine_chunks()
    if not table.num_rows:
        return
    lists = table["held"].chunk(0)
    sizes = np.diff(lists.offsets.to_numpy())
    coded = lists.flatten().dictionary_encode()
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    block = np.repeat(table["block"].to_numpy(), sizes).astype(np.int64)
    number = np.repeat(table["number"].to_numpy(), sizes)
    order = np.lexsort((number, word, block))
    block, word, number = block[order], word[order], number[order]
    new = np.flatnonzero(np.r_[True, (block[1:] != block[:-1]) | (word[1:] != word[:-1])])
    numbers = pa.ListArray.from_arrays(pa.array(np.r_[new, len(number)], pa.int32()), pa.array(number, pa.int32()))
    out = pa.RecordBatch.from_arrays(
        [pa.array(block[new], pa.int32()), coded.dictionary.take(pa.array(word[new])), numbers], names=["block", "word", "numbers"]
    )
    for first in range(0, out.num_rows, 10_000):
        yield out.slice(first, 10_000)
