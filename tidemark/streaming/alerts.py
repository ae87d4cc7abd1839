"""The morning and noon decision over a stream, with state by scope: flags of the day, and its ids as a map."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "scope string, day string, role string, n_new long"
#: Ids are forgotten so long after they were last written, and with the next day.
KEEP_MS = 36 * 3600 * 1000
MORNING, NOON, QUIET_FROM, QUIET_TO = 9, 12, 21, 7
TURKEY = timezone(timedelta(hours=3))


def quiet(hour: int) -> bool:
    return hour >= QUIET_FROM or hour < QUIET_TO


class Decisions(StatefulProcessor):
    """Fires morning once a day if there are ids, then noon once if there are ids not seen; at most two a day.

    Flags and ids are one day's of one scope: a new day starts them anew, late days are left out. An id is one
    entry of a map, written when it is first seen; the others are not touched. A row with `at` in quiet hours fires nothing.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.flags = handle.getValueState("flags", "day string, morning boolean, noon boolean", ttlDurationMs=KEEP_MS)
        self.seen = handle.getMapState("seen", "id string", "day string", ttlDurationMs=KEEP_MS)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        day, morning, noon = self.flags.get() if self.flags.exists() else ("", False, False)
        out = []
        got = pd.concat(list(rows)).sort_values(["day", "role", "id"])
        if "hour" in got:
            got = got[~got["hour"].map(quiet)]
        for (d, role), part in got.groupby(["day", "role"], sort=True):  # morning before noon
            if d < day:
                continue
            if d > day:
                day, morning, noon = d, False, False
                self.seen.clear()
            fires = not morning if role == "morning" else role == "noon" and morning and not noon
            if not fires:
                continue
            new = [i for i in dict.fromkeys(part["id"]) if not self.seen.containsKey((i,))]
            if role == "noon" and not new:
                continue
            out.append((key[0], day, role, len(new)))
            for i in new:
                self.seen.updateValue((i,), (day,))
            morning, noon = True, noon or role == "noon"
        self.flags.update((day, morning, noon))
        yield pd.DataFrame(out, columns=["scope", "day", "role", "n_new"])

    def close(self) -> None:
        pass


def decision_stream(rows: DataFrame) -> DataFrame:
    """rows: a stream of scope, day, role (morning or noon), id, and perhaps hour (of the clock where it is shown); out: what fires, as it does.

    Needs the RocksDB state store.
    """
    return rows.groupBy("scope").transformWithStateInPandas(Decisions(), OUT, "Append", "ProcessingTime")


class Slots(StatefulProcessor):
    """Decides by timers of the stream's own time: a slot tells of the ids that came up to it, however late it is that it fires."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flags = handle.getValueState("flags", "day string, morning boolean")
        self.ids = handle.getMapState("ids", "id string", "since_ms long, told boolean")

    @staticmethod
    def slot_ms(day: str, hour: int) -> int:
        return int(datetime.fromisoformat(day).replace(hour=hour, tzinfo=TURKEY).timestamp() * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        day, morning = self.flags.get() if self.flags.exists() else ("", False)
        for d, part in pd.concat(list(rows)).groupby("day", sort=True):
            if d < day:
                continue
            if d > day:
                day, morning = d, False
                self.ids.clear()
                for at in list(self.handle.listTimers()):
                    self.handle.deleteTimer(at)
                for hour in (MORNING, NOON):
                    if not quiet(hour):
                        self.handle.registerTimer(self.slot_ms(d, hour))
            for i, first in part.groupby("id")["at"].min().items():
                if not self.ids.containsKey((i,)):
                    self.ids.updateValue((i,), (int(first.timestamp() * 1000), False))
        self.flags.update((day, morning))
        yield pd.DataFrame(columns=["scope", "day", "role", "n_new"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        out = []
        if self.flags.exists():
            day, morning = self.flags.get()
            slot = expiredTimerInfo.getExpiryTimeInMs()
            role = "morning" if slot == self.slot_ms(day, MORNING) else "noon"
            new = [(i, since) for i, (since, told) in self.ids.iterator() if not told and since <= slot]
            if new and (role == "morning" or morning):
                out.append((key[0], day, role, len(new)))
                for i, since in new:
                    self.ids.updateValue(i, (since, True))
                self.flags.update((day, True))
            if role == "noon":  # the day is over
                self.ids.clear()
        yield pd.DataFrame(out, columns=["scope", "day", "role", "n_new"])

    def close(self) -> None:
        pass


def slot_stream(rows: DataFrame, late: str = "10 minutes") -> DataFrame:
    """rows: a stream of scope, day, id, at (timestamp); out: what the day's slots fire once the stream's time, less `late`, has passed them.

    Rows of a day that come after its noon have no slot left. Needs the RocksDB state store.
    """
    return rows.withWatermark("at", late).groupBy("scope").transformWithStateInPandas(Slots(), OUT, "Append", "EventTime")
