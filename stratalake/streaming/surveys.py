"""Surveys as a stream: row-wise operators run as they are; those over a survey's rows run on each batch or keep state."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import selection
from ..roles import Roles, col


def filter_stream(stream: DataFrame, column: str, values, invert: bool = False) -> DataFrame:
    """Rows of the stream that match: a stateless filter."""
    return selection.slice_by_values(stream, column, values, invert)


def each_batch(stream: DataFrame, operator: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Apply an operator over whole surveys to each batch; for sources whose batches hold surveys whole."""
    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, i: sink(operator(df), i)).trigger(availableNow=True).start()


def running_thickness(stream: DataFrame, column: str, values: Iterable[str]) -> DataFrame:
    """(nr, thickness) after each batch: the layers of a survey may come in any number of batches."""
    roles = Roles.of(stream)
    wanted = set(values)

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0.0
        for pdf in parts:
            total += float((pdf["bottom"] - pdf["top"]).abs()[pdf["value"].isin(wanted)].sum())
        state.update((total,))
        yield pd.DataFrame({"nr": [key[0]], "thickness": [total]})

    rows = stream.select(F.col(roles.nr).cast("string").alias("nr"), F.col(roles.top).alias("top"), F.col(roles.depth).alias("bottom"), F.col(column).alias("value"))
    return rows.groupBy("nr").applyInPandasWithState(update, "nr string, thickness double", "total double", "update", GroupStateTimeout.NoTimeout)


def first_top(rows: list[tuple[float, float, bool]], min_thickness: float | None = None, min_fraction: float | None = None) -> float | None:
    """The top that :func:`layers.layer_top` finds for the rows (top, bottom, matches) of one survey."""
    rows = sorted(rows)
    if min_thickness is None:
        return next((top for top, _, ok in rows if ok), None)
    runs: list[list] = []
    for top, bottom, ok in rows:
        if runs and runs[-1][2] == ok:
            runs[-1][1] = max(runs[-1][1], bottom)
        else:
            runs.append([top, bottom, ok])
    for i, (top, bottom, ok) in enumerate(runs):
        if ok and min_fraction is None and bottom - top >= min_thickness:
            return top
        if ok and min_fraction is not None:
            end = top + min_thickness
            share = sum(min(b, end) - t for t, b, k in runs[i:] if k and t < end) / min_thickness
            if share > min_fraction or abs(share - min_fraction) <= 1e-8 + 1e-5 * abs(min_fraction):
                return top
    return None


class LayerTops(StatefulProcessor):
    """Keeps the layers of a survey as a list and a timer; when the timer runs out the survey is closed and its top made."""

    def __init__(self, wait_ms: int, min_thickness: float | None, min_fraction: float | None):
        self.wait, self.rule = wait_ms, (min_thickness, min_fraction)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.layers = handle.getListState("layers", "top double, bottom double, ok boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for pdf in rows:
            self.layers.appendList(list(pdf[["top", "bottom", "ok"]].itertuples(index=False, name=None)))
            last = int(pdf["at"].max())
            latest = last if latest is None else max(latest, last)
        if latest is not None:
            # Later rows put the end off; earlier ones that come late don't bring it forward.
            before = list(self.handle.listTimers())
            due = max([latest + self.wait, *before])
            for timer in before:
                if timer < due:
                    self.handle.deleteTimer(timer)
            if due not in before:
                self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        top = first_top([tuple(r) for r in self.layers.get()], *self.rule)
        self.layers.clear()
        if top is not None:
            yield pd.DataFrame({"nr": [key[0]], "top": [top]})

    def close(self) -> None:
        pass


def layer_tops(stream: DataFrame, column: str, values: Iterable[str], time: str, wait: str = "1 hour", min_thickness: float | None = None, min_fraction: float | None = None) -> DataFrame:
    """(nr, top) of surveys whose layers come in any number of batches and any order, by the rules of layers.layer_top.

    A survey is closed, its top made and its state dropped when the watermark (``wait`` behind the latest ``time``) has
    passed its last row by ``wait``; rows behind the watermark are too late. The state is a survey's own layers, in the
    RocksDB store that the session must be set to.
    """
    roles = Roles.of(stream)
    roles.need("top", "depth")
    wait_ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    rows = stream.where(col(roles.top).isNotNull() & col(roles.depth).isNotNull()).withWatermark(time, wait)
    ok = F.coalesce(col(column).isin(*values), F.lit(False))
    rows = rows.select(col(roles.nr).cast("string").alias("nr"), col(roles.top).cast("double").alias("top"), col(roles.depth).cast("double").alias("bottom"), ok.alias("ok"), F.unix_millis(time).alias("at"), col(time).alias("_time"))
    return rows.groupBy("nr").transformWithStateInPandas(LayerTops(wait_ms, min_thickness, min_fraction), "nr string, top double", "append", "EventTime")
