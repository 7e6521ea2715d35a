"""Streams: like toggles as a state per (user, review), and ingestion of landed files in micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.ingest import first_wins, not_yet


def _toggle(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    liked = state.get[0] if state.exists else False
    n = sum(len(b) for b in batches)
    liked ^= bool(n % 2)
    state.update((liked,))
    yield pd.DataFrame({"user_id": [str(key[0])], "review_id": [str(key[1])], "liked": [liked]})


def like_states(toggles: DataFrame, user: str, target: str) -> DataFrame:
    """A stream of the latest state of every toggled pair; summed up it equals like_parity over the same log."""
    rows = toggles.where(F.col(user).isNotNull() & F.col(target).isNotNull())
    pairs = rows.select(F.col(user).cast("string").alias("u"), F.col(target).cast("string").alias("t"))
    return pairs.groupBy("u", "t").applyInPandasWithState(_toggle, "user_id string, review_id string, liked boolean", "liked boolean", "update", GroupStateTimeout.NoTimeout)


def ingest_stream(pages: DataFrame, key: str, existing: Callable[[], DataFrame], append: Callable[[DataFrame], None], checkpoint: str, order: tuple[str, ...] = ()):
    """Adds rows with new keys in each micro-batch, of several with one key the first by order (without it, by all columns); rerunning a batch adds nothing."""

    def step(batch: DataFrame, _: int) -> None:
        append(not_yet(first_wins(batch, key, *(order or batch.columns)), existing(), key))

    return pages.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
