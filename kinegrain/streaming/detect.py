"""The threshold rules on a stream of readings: edges of a held mask and jumps, per recording.

State per recording is the last reading and the last time the mask was true. Within a trigger rows are
taken in order of time; rows later than the watermark are dropped by the engine. Equal to the batch rules
for streams whose triggers follow one another in time.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_boundaries(readings: DataFrame, key: str = "episode", event_time: str = "at", speed: str = "speed", speed_change: float = 0.15, stop_speed: float = 0.015, hold: float = 0.15, watermark: str = "10 minutes") -> DataFrame:
    """(key, t, kind) of every boundary; ``readings`` has key, event_time (timestamp) and speed."""
    kind = readings.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, seen, held = state.get if state.exists else (None, None, False)
        out = []
        for r in pd.concat(list(batches)).sort_values("__t").itertuples(index=False):
            t, v = float(r.t_s), float(r.v)
            seen = t if v <= stop_speed else seen
            now = seen is not None and t <= seen + hold
            if last is not None and abs(v - last) >= speed_change:
                out.append((k[0], t, "jump"))
            if now != held:
                out.append((k[0], t, "stop"))
            last, held = v, now
        state.update((last, seen, held))
        yield pd.DataFrame(out, columns=["__key", "t", "kind"])

    d = readings.withWatermark(event_time, watermark).select(F.col(key).alias("__key"), F.col(event_time).alias("__t"), (F.unix_micros(F.col(event_time)) / 1e6).alias("t_s"), F.col(speed).alias("v"))
    found = d.groupBy("__key").applyInPandasWithState(step, f"__key {kind}, t double, kind string", "last double, seen double, held boolean", "append", GroupStateTimeout.NoTimeout)
    return found.withColumnRenamed("__key", key)
