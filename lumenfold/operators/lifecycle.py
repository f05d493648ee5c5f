"""Alert lifecycle: bands with hysteresis, resolve timer, streaks; one rule for batch and stream."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass
from datetime import datetime, timedelta

# Levels, the floors of their bands, and the margin of hysteresis.
LEVELS = ("low", "medium", "high", "critical")
FLOORS = {"medium": 31, "high": 56, "critical": 76}
MARGIN = 6
RESOLVE_AFTER = timedelta(days=7)
COOLDOWN = timedelta(hours=24)


def next_level(score: float, level: str) -> str:
    """Rises to the highest band whose floor + margin is reached; falls below bands whose floor - margin isn't passed."""
    rank = LEVELS.index(level)
    up = max((i for i, x in enumerate(LEVELS) if i and score >= FLOORS[x] + MARGIN), default=0)
    if up > rank:
        return LEVELS[up]
    while rank and score <= FLOORS[LEVELS[rank]] - MARGIN:
        rank -= 1
    return LEVELS[rank]


@dataclass
class AlertState:
    """What is known of one alert key between observations."""

    level: str = "low"
    state: str = "none"
    clear_since: datetime | None = None
    resolved_at: datetime | None = None
    peak: int = 0
    last_at: datetime | None = None

    def advance(self, at: datetime, score: float) -> str:
        """Applies one observation; returns the transition.

        An observation older than the last is late and one at the same moment is a
        replay: both leave the state alone and are reported instead of dropped. In
        the day after it was resolved an alert fires again only above its peak.
        """
        if self.last_at is not None and at <= self.last_at:
            return "late" if at < self.last_at else "replay"
        self.last_at = at
        before = LEVELS.index(self.level)
        if self.state in ("none", "resolved"):
            new = LEVELS.index(next_level(score, "low"))
            cooling = self.resolved_at is not None and at - self.resolved_at < COOLDOWN
            if new == 0 or (cooling and new <= self.peak):
                return "cooldown" if new else "quiet"
            self.level, self.state, self.peak, self.clear_since, self.resolved_at = LEVELS[new], "open", new, None, None
            return "opened"
        self.level = next_level(score, self.level)
        rank = LEVELS.index(self.level)
        self.peak = max(self.peak, rank)
        if rank > before:
            self.state, self.clear_since = "escalated", None
            return "escalated"
        if rank == 0 and score <= FLOORS["medium"] - MARGIN:
            since = self.clear_since if self.state == "downgraded" and self.clear_since else at
            self.clear_since = since
            if at - since >= RESOLVE_AFTER:
                self.state, self.resolved_at = "resolved", at
                return "resolved"
            self.state = "downgraded"
            return "downgraded" if since == at else "unchanged"
        if rank < before:
            self.state, self.clear_since = "downgraded", None
            return "downgraded"
        if self.state == "downgraded" and self.clear_since is not None:
            self.clear_since = None
            return "rebounded"
        return "unchanged"


def fold(observations: Iterable[tuple[int, datetime, float]], state: AlertState) -> Iterator[tuple[int, str, str, str]]:
    """(event_id, transition, state, level) for observations in order of time."""
    for event_id, at, score in observations:
        moved = state.advance(at, min(100.0, max(0.0, score)))
        yield event_id, moved, state.state, state.level


def as_row(state: AlertState) -> tuple:
    return tuple(asdict(state).values())
