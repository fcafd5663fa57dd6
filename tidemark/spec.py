"""What a record stream is: which columns name its key, time, order and roles, and lengths of time."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


@dataclass(frozen=True, slots=True)
class StreamSpec:
    """keys part the streams (each is one sequence of records); order breaks ties of ts, so the record order is total."""

    keys: tuple[str, ...]
    ts: str
    order: tuple[str, ...] = ()
    reset: str | None = None
    sequence: str | None = None
    category: str | None = None
    learning: str | None = None

    def records(self, *within: str | Column) -> WindowSpec:
        """A window over each stream (and what it is parted by further), in record order."""
        return Window.partitionBy(*self.keys, *within).orderBy(self.ts, *self.order)

    @property
    def first_by(self) -> Column:
        """The record order as one comparable value, for min_by and max_by."""
        return F.struct(self.ts, *self.order)


#: Units of an interval in seconds.
SECONDS = {"weeks": 604800.0, "days": 86400.0, "hours": 3600.0, "minutes": 60.0, "seconds": 1.0, "milliseconds": 1e-3, "microseconds": 1e-6}


@dataclass(frozen=True, slots=True)
class Interval:
    """Months, or seconds; both at once have no fixed length and are refused where one is needed."""

    months: int = 0
    seconds: float = 0.0

    @classmethod
    def of(cls, **units: float) -> Interval:
        """From units: years, months, weeks, days, hours, minutes, seconds, milliseconds, microseconds."""
        if unknown := units.keys() - SECONDS.keys() - {"years", "months"}:
            raise ValueError(f"unknown units: {sorted(unknown)}")
        return cls(int(units.get("years", 0) * 12 + units.get("months", 0)), sum(SECONDS[u] * n for u, n in units.items() if u in SECONDS))

    def __bool__(self) -> bool:
        return bool(self.months or self.seconds)

    @property
    def micros(self) -> int:
        if self.months:
            raise ValueError("months have no fixed length")
        return round(self.seconds * 1e6)

    def over(self, other: Interval) -> float:
        """How many of other fit; months go by months only, seconds by seconds."""
        if (self.months and (self.seconds or not other.months)) or other.months and (other.seconds or not self.months):
            raise ValueError("months and seconds don't mix")
        return self.months / other.months if other.months else self.seconds / other.seconds


class InferenceType(Enum):
    TEMPORAL_NEXT_STEP = "TemporalNextStep"
    TEMPORAL_CLASSIFICATION = "TemporalClassification"
    NONTEMPORAL_CLASSIFICATION = "NontemporalClassification"
    TEMPORAL_ANOMALY = "TemporalAnomaly"
    NONTEMPORAL_ANOMALY = "NontemporalAnomaly"
    TEMPORAL_MULTI_STEP = "TemporalMultiStep"
    NONTEMPORAL_MULTI_STEP = "NontemporalMultiStep"

    @property
    def temporal(self) -> bool:
        return self.name.startswith("TEMPORAL")


@dataclass(frozen=True, slots=True)
class Aggregation:
    """fields: (column, function) pairs; columns that aren't named take their first value."""

    period: Interval
    fields: tuple[tuple[str, str], ...] = field(default_factory=tuple)


def micros(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp"))
