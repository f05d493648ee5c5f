"""Alert states in a stream: the lifecycle of each key, with state that expires once it holds no decision."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timedelta, timezone
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lumenfold.operators.lifecycle import COOLDOWN, AlertState, as_row, fold

STATE = "held array<struct<user_id: string, event_type: string, level: string, state: string, clear_since: long, resolved_at: long, peak: int, last_at: long>>"
MOVES = "user_id long, event_type string, event_id long, transition string, state string, level string"
TTL = timedelta(days=30)
BUCKETS = 16_384  # of keys whose states are kept in one row of the state store; fixed for the life of a checkpoint
EPOCH = datetime(1970, 1, 1)
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def holds_decision(state: AlertState, now: datetime) -> bool:
    """Whether forgetting the state could change what happens next: an alert is open, or one was resolved within the cooldown."""
    if state.state not in ("none", "resolved"):
        return True
    return state.resolved_at is not None and now - state.resolved_at < COOLDOWN


def _micros(at: datetime | None) -> int | None:
    return None if at is None else (at - EPOCH) // timedelta(microseconds=1)


def _moment(micros: int | None) -> datetime | None:
    return None if micros is None else EPOCH + timedelta(microseconds=micros)


def _pack(state: AlertState) -> tuple:
    return tuple(_micros(x) if isinstance(x, datetime) else x for x in as_row(state))


def _unpack(level: str, name: str, clear_since: int | None, resolved_at: int | None, peak: int, last_at: int | None) -> AlertState:
    return AlertState(level, name, _moment(clear_since), _moment(resolved_at), peak, _moment(last_at))


def _advance(ttl: timedelta) -> Callable[[Any, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    """Folds each micro-batch of a bucket of keys into their states, then gives up those that hold no decision for ``ttl``."""

    def advance(bucket: Any, rows: Iterator[pd.DataFrame], held: GroupState) -> Iterator[pd.DataFrame]:
        states = {(r[0], r[1]): _unpack(*r[2:]) for r in held.get[0]} if held.exists else {}
        out = []
        if not held.hasTimedOut:  # the rows of a bucket and micro-batch
            batch = [(ts.to_pydatetime(), int(i), user, kind, float(v)) for part in rows for ts, i, user, kind, v in zip(*(part[c] for c in ("ts", "event_id", "user_id", "event_type", "value")), strict=True)]
            for at, i, user, kind, v in sorted(batch, key=lambda r: r[:2]):
                state = states.setdefault((user, kind), AlertState())
                out += [(None if user is None else int(user), kind, *r) for r in fold([(i, at, v)], state)]
        now = EPOCH + timedelta(milliseconds=max(0, held.getCurrentWatermarkMs()))
        states = {k: s for k, s in states.items() if s.last_at + ttl > now or holds_decision(s, now)}
        if states:
            held.update(([(*k, *_pack(s)) for k, s in states.items()],))
            ends = [s.last_at + ttl for s in states.values() if s.state in ("none", "resolved")]
            if ends:
                held.setTimeoutTimestamp(max(_micros(min(ends)) // 1000, held.getCurrentWatermarkMs() + 1))
        elif held.exists:
            held.remove()
        if out:
            made = pd.DataFrame(out, columns=["user_id", "event_type", "event_id", "transition", "state", "level"])
            yield made.assign(user_id=pd.array([r[0] for r in out], dtype="Int64"))

    return advance


def alert_moves(events: DataFrame, late: str = "31 days", ttl: timedelta = TTL) -> DataFrame:
    """(user_id, event_type, event_id, transition, state, level) of a stream of observations.

    ``events`` (user_id, event_type, event_id, ts, value). Observations of a key in one micro-batch are sorted by
    time; one that is older than those of an earlier micro-batch is reported as late. States live in the state store and
    are written at each batch, so a restart goes on from the last. A state is given up when the watermark has passed ``ttl``
    since its last observation, but only if it holds no decision: an open alert is never forgotten, at any age.

    Calls into Python and rows of the state store are one a bucket of keys, at most BUCKETS a micro-batch: with one a
    key, its fixed cost of some milliseconds is most of the work.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    # Ids as strings: pandas would make floats of longs beside a null.
    timed = events.select(F.pmod(F.xxhash64("user_id", "event_type"), F.lit(BUCKETS)).alias("bucket"), F.col("user_id").cast("string").alias("user_id"), "event_type", "event_id", "ts", "value").withWatermark("ts", late)
    return timed.groupBy("bucket").applyInPandasWithState(_advance(ttl), MOVES, STATE, "append", GroupStateTimeout.EventTimeTimeout)
