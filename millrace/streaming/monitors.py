"""Stateful monitors over event streams, and their batch twins.

dependency(): per session, a disclosure when the trailing hour holds many events or short gaps have piled up; then not
again until a cooldown is over, which also clears the gaps. A decision depends on earlier ones, so it is state,
not a window. rolling(): failure rate over the last so many checks per key.

Time is event time: a stream's events are ordered within each micro-batch, and a watermark bounds how late one may be.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


@dataclass(frozen=True)
class Limits:
    per_hour: int = 10
    gap: float = 30.0
    bursts: int = 5
    cooldown: float = 3600.0


Session = tuple[list[float], int, bool, float]
START: Session = ([], 0, False, 0.0)


def step(state: Session, now: float, limits: Limits) -> tuple[Session, bool]:
    """The session after an event at now (seconds), and whether to disclose."""
    times, bursts, sent, last = state
    if times and now - times[-1] < limits.gap:
        bursts += 1
    times = [t for t in [*times, now] if t >= now - 3600]
    if sent and now - last >= limits.cooldown:
        sent, bursts = False, 0
    fire = not sent and (len(times) >= limits.per_hour or bursts >= limits.bursts)
    return (times, bursts, sent or fire, now if fire else last), fire


RESULT = "session long, event_id long, disclose boolean, bursts int, in_hour int"


def dependency_batch(events: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """events (session, event_id, at: seconds): one row each, with the decision."""

    def one(rows: pd.DataFrame) -> pd.DataFrame:
        state, out = START, []
        for r in rows.sort_values(["at", "event_id"]).itertuples():
            state, fire = step(state, r.at, limits)
            out.append((r.session, r.event_id, fire, state[1], len(state[0])))
        return pd.DataFrame(out, columns=["session", "event_id", "disclose", "bursts", "in_hour"])

    return events.select("session", "event_id", "at").groupBy("session").applyInPandas(one, RESULT)


def dependency_stream(events: DataFrame, limits: Limits = Limits(), late: str = "1 hour", idle: float = 7 * 86400.0) -> DataFrame:
    """The same over a stream: state per session is its last hour's times and three numbers.

    Events later than the watermark (late behind the latest seen) are dropped; the state of a session that had no event for idle seconds
    goes, and its gaps are forgotten with it.
    """

    def some(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        now: Session = START
        if state.exists:
            times, bursts, sent, last = state.get
            now = (list(times), bursts, sent, last)
        rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
        out = []
        for r in rows.itertuples():
            now, fire = step(now, r.at, limits)
            out.append((key[0], r.event_id, fire, now[1], len(now[0])))
        state.update(now)
        state.setTimeoutTimestamp(max(int((rows["at"].iloc[-1] + idle) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["session", "event_id", "disclose", "bursts", "in_hour"])

    rows = events.select("session", "event_id", "at", F.timestamp_millis((F.col("at") * 1000).cast("long")).alias("ts")).withWatermark("ts", late).groupBy("session")
    return rows.applyInPandasWithState(some, RESULT, "times array<double>, bursts int, sent boolean, last double", "append", GroupStateTimeout.EventTimeTimeout)


def rolling_stream(checks: DataFrame, size: int = 50) -> DataFrame:
    """checks (key string, at double, failed boolean) as a stream: the failure rate over the last size checks of the key, per check."""

    def some(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = list(state.get[0]) if state.exists else []
        out = []
        for r in pd.concat(list(batches)).sort_values(["at", "check_id"]).itertuples():
            last = [*last, bool(r.failed)][-size:]
            out.append((key[0], r.check_id, sum(last) / len(last)))
        state.update((last,))
        yield pd.DataFrame(out, columns=["key", "check_id", "rate"])

    rows = checks.select("key", "check_id", "at", "failed").groupBy("key")
    return rows.applyInPandasWithState(some, "key string, check_id long, rate double", "last array<boolean>", "append", GroupStateTimeout.NoTimeout)


def hourly(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Counts and means per hour and kind over a stream of (ts, kind, value); events later than the watermark are dropped."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 hour"), "kind").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
