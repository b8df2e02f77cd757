"""Online learning over streams: one model for each key, updated in event order within every micro-batch."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ordinata.operators.saddle import Saddle, Walk

_STATE = "seen long, positives long, v array<double>, alpha double"
_OUT = "model_id long, t long, share double, w array<double>"


def solam_stream(events: DataFrame, d: int, xi: float = 1.0, radius: float = 1.0) -> DataFrame:
    """(model_id, t, share, w) after every micro-batch of (model_id, ts, event_id, y, features).

    A step depends on the one before, so a key is one sequential task; keys run in parallel. Rows of a micro-batch are
    applied by (ts, event_id); a row that arrives in a later batch is applied there.
    """

    rule = Saddle(radius, xi)

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        way = rule.start(d)
        if state.exists:
            seen, positives, v, alpha = state.get
            way = Walk(np.array(v), alpha, seen, positives)
        rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
        for x, y in zip(rows["features"], rows["y"], strict=True):
            way.step(np.asarray(x, float), y > 0, xi / math.sqrt(way.seen + 1), rule.project)
        state.update((int(way.seen), int(way.positives), way.v.tolist(), float(way.alpha)))
        yield pd.DataFrame({"model_id": [key[0]], "t": [int(way.seen)], "share": [way.share], "w": [way.v[:d].tolist()]})

    return events.groupBy("model_id").applyInPandasWithState(update, _OUT, _STATE, "update", "NoTimeout")
