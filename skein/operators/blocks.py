"""Blocks of scores in Arrow: the best few of each column, over the blocks that a task sees."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa


#: Scores in a block; rows are cut so that it has no more, or one row.
CELLS = 1 << 20


def row_slices(n_rows: int, n_columns: int):
    """Slices of rows whose scores are at most CELLS."""
    step = max(1, CELLS // max(1, n_columns))
    for at in range(0, n_rows, step):
        yield at, min(n_rows, at + step)


class Best:
    """The k best scores of each column so far, so that later blocks only hand on what may still be among them."""

    def __init__(self, k: int, n_columns: int):
        self.held = np.full((k, n_columns), -np.inf)
        self.least = np.full(n_columns, -np.inf)

    def chosen(self, shown: np.ndarray) -> np.ndarray:
        """Which scores are among the k best up to and with this block, or tie with the last."""
        some = np.flatnonzero((shown > self.least).any(0))
        if len(some):
            k = len(self.held)
            both = np.concatenate([self.held[:, some], shown[:, some]])
            self.held[:, some] = np.partition(both, len(both) - k, axis=0)[len(both) - k :]
            self.least[some] = self.held[:, some].min(0)
        return shown >= self.least


def best_rows(scores: np.ndarray, row_ids: pa.Array, column_ids: list, k: int, keep: Callable[[np.ndarray], np.ndarray], column_type: pa.DataType, row_type: pa.DataType, best: Best | None = None) -> pa.RecordBatch:
    """(query_id, chunk_id, score) of the k best rows of each column, and all that tie with the last at six digits; best: what the task has seen before counts too."""
    shown = np.round(scores, 6)
    if best is not None:
        chosen = best.chosen(shown) & keep(shown)
    elif len(shown) > k:
        least = np.partition(shown, len(shown) - k, axis=0)[len(shown) - k]
        chosen = (shown >= least) & keep(shown)
    else:
        chosen = keep(shown)
    row, column = np.nonzero(chosen)
    ids = row_ids.cast(row_type).take(pa.array(row))
    return pa.RecordBatch.from_arrays([pa.array([column_ids[c] for c in column.tolist()], column_type), ids, pa.array(scores[row, column])], ["query_id", "chunk_id", "score"])
