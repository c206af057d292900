"""Map buffers over a stream of events: the batch rules with their state kept between micro-batches."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tessera.operators.buffer import RESULTS, Buffer, frame_rows


def stitched_stream(events: DataFrame) -> DataFrame:
    """RESULTS of a stream of events (see operators.buffer). A buffer's state is its stored frames and its base; links go downstream.

    Within a micro-batch events are taken by seq; across batches, as they arrive. REMOVE frees the state.
    """
    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        buffer = pickle.loads(state.get[0]) if state.exists else Buffer()
        rows, removed = [], False
        for e in pd.concat(list(batches)).sort_values("seq").itertuples(index=False):
            rows += buffer.apply(e)
            removed = e.kind == "REMOVE"
        if removed:
            state.remove()
        else:
            state.update((pickle.dumps(buffer),))
        yield frame_rows(int(key[0]), rows)

    return events.groupBy("buffer_id").applyInPandasWithState(run, RESULTS, "state binary", "append", GroupStateTimeout.NoTimeout)
