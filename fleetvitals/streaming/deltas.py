"""Counter deltas on a stream of captures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout


def delta_stream(
    stream: DataFrame,
    keys: Sequence[str],
    counters: Sequence[str],
    time: str = "captured_at",
    delay: str = "10 minutes",
    mode: str = "signed",
) -> DataFrame:
    """Change of each counter from one capture of a key to its next, on an unbounded stream.

    Captures may arrive out of order by up to ``delay``: they wait in the key's state until the watermark
    has passed them, and then leave in time order.  The state of a key is its last emitted capture plus
    the captures of the last ``delay``.  The first capture of a key gives no row.

    The counters are whole numbers; a change from or to NULL is NULL, and of captures at one instant NULL comes first, as in
    ``counter_deltas``, whose ``mode`` this has too.  Output mode is append.  Captures behind the watermark are dropped;
    ``delta_sink`` keeps them.
    """
    if mode not in ("signed", "abs", "null"):
        raise ValueError("mode must be signed, abs or null")
    keys, counters = list(keys), list(counters)
    for name, kind in stream.dtypes:
        if name == time and kind == "timestamp_ntz":
            # a watermark needs an instant
            stream = stream.withColumn(time, F.col(time).cast("timestamp"))
    types = {f.name: f.dataType for f in stream.schema.fields}
    output = T.StructType(
        [T.StructField(k, types[k]) for k in keys]
        + [T.StructField("from_time", T.TimestampType()), T.StructField(time, T.TimestampType())]
        + [T.StructField(f"{c}_delta", T.LongType()) for c in counters]
    )
    # instants are microseconds; captures are kept as flat runs of (instant, then for each counter: there, value)
    state_type = T.StructType(
        [
            T.StructField("last", T.ArrayType(T.LongType())),
            T.StructField("waiting", T.ArrayType(T.LongType())),
        ]
    )

    def update(key, frames, state):
        import numpy as np
        import pandas as pd

        width = 1 + 2 * len(counters)
        last, flat = ([], []) if not state.exists else (list(state.get[0]), list(state.get[1]))
        rows = [tuple(flat[i : i + width]) for i in range(0, len(flat), width)]
        for frame in frames:
            instants = pd.DatetimeIndex(frame[time]).as_unit("us").asi8
            columns = [frame[f"{part}{c}"].tolist() for c in counters for part in ("_there_", "")]
            rows.extend(zip(instants.tolist(), *columns, strict=True))
        rows.sort()
        ready_until = state.getCurrentWatermarkMs() * 1000
        ready = [r for r in rows if r[0] <= ready_until]
        kept = rows[len(ready) :]
        emitted = []
        for row in ready:
            if last:
                emitted.append((last, row))
            last = list(row)
        state.update((last, [value for row in kept for value in row]))
        if kept:
            # a timeout fires once the watermark has passed it, and has to lie beyond the present one
            state.setTimeoutTimestamp(max(kept[0][0] // 1000 - 1, state.getCurrentWatermarkMs() + 1))
        if emitted:
            old, new = (np.array(side, dtype="int64") for side in zip(*emitted, strict=True))
            columns = {name: [value] * len(emitted) for name, value in zip(keys, key, strict=True)}
            for name, side in (("from_time", old), (time, new)):
                columns[name] = pd.DatetimeIndex(side[:, 0].astype("datetime64[us]")).tz_localize("UTC")
            for i, name in enumerate(counters):
                change = new[:, 2 * i + 2] - old[:, 2 * i + 2]
                known = (new[:, 2 * i + 1] == 1) & (old[:, 2 * i + 1] == 1)
                if mode == "null":
                    known &= change >= 0
                columns[f"{name}_delta"] = pd.arrays.IntegerArray(abs(change) if mode == "abs" else change, ~known)
            yield pd.DataFrame(columns)

    return (
        stream.select(
            *keys,
            time,
            # numbers without NULL stay whole numbers on their way
            *[F.coalesce(F.col(c).cast("bigint"), F.lit(0)).alias(c) for c in counters],
            *[F.col(c).isNotNull().cast("bigint").alias(f"_there_{c}") for c in counters],
        )
        .withWatermark(time, delay)
        .groupBy(*keys)
        .applyInPandasWithState(update, output, state_type, "append", GroupStateTimeout.EventTimeTimeout)
    )
