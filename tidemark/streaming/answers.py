"""Answers that come too late: a client's answer counts only if it is to the client's latest request."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Both kinds of row: a request (body null) and the answer to one; number rises with a client's requests.
EVENT = "client string, number long, scope string, answered boolean, body string"
OUT = "client string, number long, scope string, body string"


def in_force(events: DataFrame, at: str = "at") -> DataFrame:
    """The answers among events (EVENT and their time) that are to the latest request made before them, with events' columns.

    The number decides, not the scope: an answer to a first request is stale also when the same scope is asked for again.
    At one time requests come before answers.
    """
    before = Window.partitionBy("client").orderBy(at, "answered").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    latest = F.max(F.when(~F.col("answered"), F.col("number"))).over(before)
    return events.withColumn("_latest", latest).where(F.col("answered") & (F.col("number") == F.col("_latest"))).drop("_latest")


class LatestOnly(StatefulProcessor):
    """Holds one number for each client."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "number long", ttlDurationMs=24 * 3600 * 1000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        number = self.latest.get()[0] if self.latest.exists() else -1
        got = pd.concat(list(rows))
        asked = got.loc[~got["answered"], "number"]
        number = max(number, int(asked.max()) if len(asked) else -1)
        self.latest.update((number,))
        kept = got[got["answered"] & (got["number"] == number)].drop_duplicates("number")
        yield pd.DataFrame({"client": key[0], "number": kept["number"], "scope": kept["scope"], "body": kept["body"]})

    def close(self) -> None:
        pass


def latest_only(events: DataFrame) -> DataFrame:
    """A stream of EVENT rows: the answers that are to their client's latest request as it is when they come.

    Needs the RocksDB state store. A client's number is forgotten a day after its last event.
    """
    return events.groupBy("client").transformWithStateInPandas(LatestOnly(), OUT, "Append", "ProcessingTime")
