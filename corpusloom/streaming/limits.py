"""Keyed limits over time: fixed windows that open with a client's request, and remembered requests, for tables and for streams."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.window import Window

from corpusloom.runtime import CORE, read

SECONDS, MOST = 60, 100
LATER = pd.Timedelta(seconds=SECONDS)


class Limiter:
    """A window opens with the first request after the last has been open for more than SECONDS; requests over MOST in it are refused and not counted."""

    def __init__(self, start: pd.Timestamp | None = None, n: int = 0, most: int = MOST) -> None:
        self.start, self.n, self.most = start, n, most

    def take(self, ts: pd.Timestamp) -> tuple[bool, pd.Timestamp, int]:
        if self.start is None or ts - self.start > LATER:
            self.start, self.n = ts, 0
        allowed = self.n < self.most
        self.n += allowed
        return allowed, self.start, self.n


def rate_limited(requests: DataFrame, client: str = "client_ip", ts: str = "ts", key: str = "request_id", most: int = MOST) -> DataFrame:
    """(key, client, allowed, window_start, n_in_window) of every request, in the order of its time, ties by key.

    Exact repeats of a row count once; a NULL client is a client of its own; rows without a time give none. A pause of more
    than SECONDS always opens a window, so the stretches between pauses are independent and go to different tasks, also those of one
    client. Pauses are found among the minutes in which a client asked, which are few beside its requests. A task goes through its
    stretches in order and holds the window of one.
    """
    rows = requests.where(F.col(ts).isNotNull()).select(F.col(key).alias("_key"), F.col(client).alias("_client"), F.col(ts).alias("_ts")).distinct()
    minute = F.floor(F.unix_micros("_ts") / (SECONDS * 1_000_000))
    minutes = rows.groupBy("_client", minute.alias("_minute")).agg(F.min("_ts").alias("first"), F.max("_ts").alias("last"))
    w = Window.partitionBy("_client").orderBy("_minute")
    opens = F.coalesce(F.unix_micros("first") - F.unix_micros(F.lag("last").over(w)) > SECONDS * 1_000_000, F.lit(True))
    stretches = minutes.withColumn("opens", opens).select("_client", "_minute", F.max(F.when(F.col("opens"), F.col("_minute"))).over(w).alias("_stretch"))
    placed = rows.withColumn("_minute", minute).alias("r").join(stretches.alias("s"), F.expr("r._client <=> s._client AND r._minute = s._minute")).select("r._key", "r._client", "r._ts", "s._stretch")

    def limit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now: Any = ()
        limiter = Limiter(most=most)
        for b in batches:
            out = []
            for k, c, t, s in zip(b["_key"], b["_client"], b["_ts"], b["_stretch"]):
                if (c, s) != now:
                    now, limiter = (c, s), Limiter(most=most)
                out.append((k, c, *limiter.take(t)))
            yield pd.DataFrame(out, columns=[key, client, "allowed", "window_start", "n_in_window"])

    types = dict(requests.dtypes)
    return placed.repartition("_client", "_stretch").sortWithinPartitions("_client", "_stretch", "_ts", "_key").mapInPandas(limit, f"{key} {types[key]}, {client} {types[client]}, allowed boolean, window_start timestamp, n_in_window int")


RATE_SQL = f"""
    WITH RECURSIVE r AS (SELECT DISTINCT request_id, client_ip, ts, coalesce(client_ip, '?') AS c FROM request_log WHERE ts IS NOT NULL),
    starts AS (SELECT c, min(ts) AS w FROM r GROUP BY c UNION ALL
        SELECT s.c, x.w FROM starts AS s, LATERAL (SELECT min(ts) AS w FROM r WHERE r.c = s.c AND r.ts > s.w + INTERVAL {SECONDS} SECOND) AS x WHERE x.w IS NOT NULL),
    placed AS (SELECT r.*, s.w FROM r ASOF JOIN starts AS s ON r.c = s.c AND r.ts >= s.w)
    SELECT request_id, client_ip, n <= {MOST} AS allowed, w AS window_start, CAST(least(n, {MOST}) AS INTEGER) AS n_in_window
    FROM (SELECT *, row_number() OVER (PARTITION BY c, w ORDER BY ts, request_id) AS n FROM placed)"""


@CORE.query("rate_limit", RATE_SQL)
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every request with the window of its client it falls in."""
    return rate_limited(read(spark, sf_dir, "request_log"))


@CORE.query("rate_limit_stats")
def rate_limit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clients with their windows and refused requests."""
    by = rate_limit(spark, sf_dir).groupBy("client_ip", "window_start").agg(F.count("*").alias("n"), F.count_if(~F.col("allowed")).alias("refused"))
    return by.groupBy("client_ip").agg(F.count("*").alias("n_windows"), F.sum("n").alias("n_requests"), F.sum("refused").alias("n_refused"))


def rate_limited_stream(requests: DataFrame, client: str = "client_ip", ts: str = "ts", key: str = "request_id", most: int = MOST) -> DataFrame:
    """The same over a stream: a client's window is its state, which ends when nothing came for an hour of event time. Late rows within a batch are put in order; a row before its client's window joins it."""

    def limit(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (None, 0)
        limiter = Limiter(None if start is None else pd.Timestamp(start, unit="us"), n, most)
        rows = pd.concat(list(batches)).drop_duplicates().sort_values([ts, key])
        out = [(i, k[0], *limiter.take(t)) for i, t in zip(rows[key], rows[ts])]
        state.update((int(limiter.start.value // 1000), limiter.n))
        state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), int(limiter.start.value // 1_000_000)) + 3_600_000)
        yield pd.DataFrame(out, columns=[key, client, "allowed", "window_start", "n_in_window"])

    types = dict(requests.dtypes)
    return requests.withWatermark(ts, "10 minutes").groupBy(client).applyInPandasWithState(
        limit, f"{key} {types[key]}, {client} {types[client]}, allowed boolean, window_start timestamp, n_in_window int", "start bigint, n int", "append", GroupStateTimeout.EventTimeTimeout
    )


def first_seen_stream(requests: DataFrame, keys: list[str], ts: str = "ts", seconds: int = 300) -> DataFrame:
    """The requests of a stream that were not seen with the same keys for some time, a cache whose entries live as long as the watermark allows."""
    return requests.withWatermark(ts, f"{seconds} seconds").dropDuplicatesWithinWatermark(keys)
