"""Growth of cumulative counters as a stream: the rows of ``telemetry.counter_increase``, each written once its range has closed."""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

if TYPE_CHECKING:
    import pandas as pd

_STATE = "last double, times array<long>, numbers array<double>"


def steps(values: list[float], before: float | None) -> float:
    """Growth over values in order of time; a value below the one before it means a restart from zero."""
    total = 0.0
    for value in values:
        if before is not None:
            total += value if value < before else value - before
        before = value
    return total


def counter_increase_stream(
    samples: DataFrame, series: list[str], ts: str, value: str, seconds: int, late: str, forget: int | None = None
) -> DataFrame:
    """(series, start, increase, per_second) of each range of ``seconds``, once the watermark (``late`` behind the newest sample) has passed it.

    A keyed state per series holds the last value of its last closed range and the samples of its open ranges, which may come in any
    order: restarts inside a range and across ranges, and ranges without samples in between, count as in the batch form. A timer at the end of the
    earliest open range closes it even if its series falls silent. Samples at or behind the watermark come too late and are
    dropped, and so are those without time or value.

    What a state holds is a series' samples of some ``seconds`` plus ``late``, however long the stream runs. ``forget`` (seconds of event time)
    drops the last value of a series that has been silent for so long; its next sample then starts anew.
    """
    width = seconds * 1_000_000
    known = samples.filter(F.col(ts).isNotNull() & F.col(value).isNotNull()).withWatermark(ts, late)
    rows = known.select(*series, ts, F.unix_micros(ts).alias("_t"), F.col(value).cast("double").alias("_v"))

    def follow(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        import pandas as pd

        last, times, numbers = state.get if state.exists else (None, [], [])
        held = list(zip(times, numbers))
        if not state.hasTimedOut:
            for part in parts:
                held += zip(part["_t"].tolist(), part["_v"].tolist())
        held.sort()
        passed = state.getCurrentWatermarkMs() * 1000
        ranges: dict[int, list[float]] = {}
        left = []
        for t, v in held:
            start = t // width * width
            if start + width <= passed:
                ranges.setdefault(start, []).append(v)
            else:
                left.append((t, v))
        found, end = [], None
        for start, values in ranges.items():
            found.append((*key, start, steps(values, last)))
            last, end = values[-1], start + width
        if left:
            state.update((last, [t for t, _ in left], [v for _, v in left]))
            state.setTimeoutTimestamp((left[0][0] // width + 1) * width // 1000 - 1)
        elif state.hasTimedOut and not ranges:
            state.remove()  # silent for long enough
        else:
            state.update((last, [], []))
            if forget is not None:
                state.setTimeoutTimestamp(max(passed, end or 0) // 1000 + forget * 1000)
        if found:
            yield pd.DataFrame(found, columns=[*series, "start", "increase"])

    kinds = ", ".join(f"`{c}` {samples.schema[c].dataType.simpleString()}" for c in series)
    grown = rows.groupBy(*series).applyInPandasWithState(
        follow, f"{kinds}, start long, increase double", _STATE, "append", GroupStateTimeout.EventTimeTimeout
    )
    return grown.select(
        *series, F.timestamp_micros("start").alias("start"), "increase", (F.col("increase") / F.lit(seconds)).alias("per_second")
    )
