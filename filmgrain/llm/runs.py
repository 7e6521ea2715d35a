"""Runs of equal keys in sorted Arrow batches, handed on whole although a run may cross batch borders."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables made of complete runs of equal, sorted keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(k != k[-1], False)) if k[0] == k[-1] else int(np.flatnonzero(k != k[-1])[-1]) + 1
        if last == 0 and (not held or held[-1].column(key)[-1].as_py() == k[0]):
            held.append(batch)
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, last)] if last else held)
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()
