"""The gate on a stream: periods close by event-time timers, late rows are counted, a change passes once, and causes are joined by interval."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from veridelta.operators import signal

from .signals import LEAST, change, step

#: What the state of ``transformWithStateInPandas`` needs; to be set before the query starts.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
CLOSED = "key string, period long, value double, n_rows long, n_late long, tau int, confidence double, impact_pct double, gate_passed boolean"
MICROS = 1_000_000


class PeriodGate(StatefulProcessor):
    """A key's open periods, its run-length posterior over closed ones, and what has passed the gate.

    A row goes to its open period; a period's timer fires when the watermark has reached its end, and then its sum becomes a point of the series. A
    row of a period that has closed, or lies before one that has, is late: it is counted and told with the next period that closes.
    """

    def __init__(self, seconds: int, prior: tuple[float, float, float, float], pct_threshold: float, hazard: float):
        self.seconds, self.prior, self.pct, self.hazard = seconds, prior, pct_threshold, hazard

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "period long", "total long, n long")
        self.series = handle.getValueState("series", "weight array<double>, mu array<double>, beta array<double>, run array<long>, points array<double>, period long, late long, passed int")

    def _known(self) -> tuple:
        if self.series.exists():
            got = self.series.get()
            return (*map(np.array, got[:4]), [*got[4]], *got[5:])
        return np.array([1.0]), np.array([self.prior[0]]), np.array([self.prior[3]]), np.array([0]), [], -(2**62), 0, 0

    def _keep(self, weight, mu, beta, run, points, period, late, passed) -> None:
        self.series.update((weight.tolist(), mu.tolist(), beta.tolist(), [int(x) for x in run], points, int(period), int(late), int(passed)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        *rest, last, late, passed = self._known()
        before = late
        for frame in rows:
            for period, part in frame.groupby("period"):
                period, total, n = int(period), int(part["amount"].sum()), int(part["n"].sum())
                if period <= last:
                    late += n
                elif self.open.containsKey((period,)):
                    held = self.open.getValue((period,))
                    self.open.updateValue((period,), (held[0] + total, held[1] + n))
                else:
                    self.open.updateValue((period,), (total, n))
                    self.handle.registerTimer((period + 1) * self.seconds * 1000)
        if late != before:
            self._keep(*rest, last, late, passed)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        period = expiredTimerInfo.getExpiryTimeInMs() // 1000 // self.seconds - 1
        if not self.open.containsKey((period,)):
            return
        total, n = self.open.getValue((period,))
        self.open.removeKey((period,))
        weight, mu, beta, run, points, last, late, passed = self._known()
        value = total / 10000
        points.append(value)
        weight, mu, beta, run = step(weight, mu, beta, run, value, self.prior, self.hazard, LEAST)
        tau, confidence = change(weight, run, len(points))
        pct, _ = signal.impact(np.array(points), tau)
        recent = tau > 1 and tau > len(points) - signal.RECENT_WEEKS and len(points) >= signal.SPARSE
        passes = confidence > signal.POSTERIOR and recent and abs(pct) >= self.pct and abs(tau - passed) > signal.NEIGHBOURHOOD
        self._keep(weight, mu, beta, run, points, period, 0, tau if passes else passed)
        yield pd.DataFrame({"key": [key[0]], "period": [period], "value": [value], "n_rows": [n], "n_late": [late], "tau": [tau], "confidence": [confidence], "impact_pct": [pct], "gate_passed": [bool(passes)]})


def gate_stream(rows: DataFrame, key: str, time: str, amount: str, prior: tuple[float, float, float, float], seconds: int = 7 * 86400, lateness: str = "2 days", pct_threshold: float = 0.03, hazard: float = signal.HAZARD) -> DataFrame:
    """CLOSED rows, one for each key and period of ``seconds`` that has ended by the watermark; periods count from the epoch.

    Timers fire in the order of time, so a series' points come in order. Rows with a null key, time or amount take no part. The session's state
    store must be STATE_STORE. A query that is started again from its checkpoint goes on with the same rows.
    """
    watched = rows.where(F.col(key).isNotNull() & F.col(time).isNotNull() & F.col(amount).isNotNull()).withWatermark(time, lateness)
    # whole numbers of a ten-thousandth add up alike in any order; the time goes on as a number, so that late rows reach the state
    plain = watched.select(F.col(key).cast("string").alias("key"), F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (seconds * MICROS)).cast("long").alias("period"), F.round(F.col(amount).cast("double") * 10000).cast("long").alias("amount"), F.lit(1).cast("long").alias("n"))
    return plain.groupBy("key").transformWithStateInPandas(PeriodGate(seconds, prior, pct_threshold, hazard), CLOSED, "Append", "eventTime")


def causes_before(movements: DataFrame, causes: DataFrame, window: str = "14 days", lateness: str = "2 days") -> DataFrame:
    """Each movement (key, moved_at, ...) with each cause (key, caused_at, ...) of its key that came up to ``window`` before it, of two streams.

    Both sides' watermarks bound what is kept: a cause is dropped when no movement can follow it in time any more.
    """
    left = movements.withWatermark("moved_at", lateness)
    right = causes.withColumnRenamed("key", "caused_key").withWatermark("caused_at", lateness)
    near = (F.col("key") == F.col("caused_key")) & (F.col("caused_at") <= F.col("moved_at")) & (F.col("caused_at") >= F.col("moved_at") - F.expr(f"interval {window}"))
    return left.join(right, near).drop("caused_key")
