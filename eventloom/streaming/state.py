"""Keyed state: rate limits, cooldowns, crawl health and the refresh machine.

Every rule is one fold over a key's rows in order. The batch forms run the fold
over a grouped table; :func:`rate_limit_stream` and :func:`crawl_health_stream`
keep the same state in Structured Streaming, so a restarted query goes on from its
checkpoint. The crawl's state is a value with a time to live in the RocksDB store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from eventloom.functions import score
from eventloom.functions.timewin import hours


def _allowed(kept: list[float], times: list[float], most: int, span: float) -> tuple[list[float], list[bool]]:
    """Which calls pass: fewer than ``most`` allowed calls within the span before each."""
    kept, verdicts = list(kept), []
    for t in times:
        kept = [x for x in kept if x >= t - span]
        verdicts.append(len(kept) < most)
        if verdicts[-1]:
            kept.append(t)
    return kept, verdicts


def _micros(stamps: pd.Series) -> list[float]:
    return (stamps.astype("datetime64[us]").astype("int64")).tolist()


def rate_limited(calls: DataFrame, most: int = 10, minutes: int = 60) -> DataFrame:
    """(id, client_id, allowed) of calls (id, client_id, called_at).

    A client's calls are walked in order in one task, in batches of bounded size.
    Calls without a client count as one client's.
    """
    span = minutes * 60_000_000

    def of_clients(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client, kept = object(), []
        for batch in batches:
            out = []
            for who, own in batch.groupby("client_id", sort=False, dropna=False):
                who = None if pd.isna(who) else who
                if who != client:
                    client, kept = who, []
                kept, verdicts = _allowed(kept, _micros(own["called_at"]), most, span)
                out.append(pd.DataFrame({"id": own["id"], "client_id": own["client_id"], "allowed": verdicts}))
            if out:
                yield pd.concat(out)

    ordered = calls.select("id", "client_id", "called_at").repartition("client_id").sortWithinPartitions("client_id", "called_at", "id")
    return ordered.mapInPandas(of_clients, "id long, client_id string, allowed boolean")


def rate_limit_stream(calls: DataFrame, most: int = 10, minutes: int = 60) -> DataFrame:
    """The same on a stream: the state is the times of allowed calls, dropped when the watermark has left the window behind.

    Calls that come later than one window after newer ones are dropped.
    """
    span = minutes * 60_000_000

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["called_at", "id"])
        times = _micros(rows["called_at"])
        kept, verdicts = _allowed(state.get[0] if state.exists else [], times, most, span)
        state.update(([int(x) for x in kept],))
        # At least a moment after the watermark, which may have passed a late call's window already.
        state.setTimeoutTimestamp(max((int(times[-1]) + span) // 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"id": rows["id"], "client_id": key[0], "allowed": verdicts})

    own = calls.withWatermark("called_at", f"{minutes} minutes")
    return own.groupBy("client_id").applyInPandasWithState(fold, "id long, client_id string, allowed boolean", "kept array<long>", "append", GroupStateTimeout.EventTimeTimeout)


HEALTH = "venue_id long, total_scans long, total_passed long, consecutive_empty long, consecutive_errors long, avg_quality double, next_hours double, page_hash string"
_START = {"total_scans": 0, "total_passed": 0, "consecutive_empty": 0, "consecutive_errors": 0, "avg_quality": 0.0, "next_hours": 0.0, "page_hash": None, "passed": 0}


def next_health(before: dict, passed: int, batch_quality: float, outcome: str, page_hash: str | None) -> dict:
    """One venue's state after one more scan; an unchanged page counts as a scan that found nothing."""
    scans = before["total_scans"] + 1
    error = outcome == "error"
    if passed > 0:
        wait = 6.0
    elif outcome == "unchanged" and before["passed"] > 0:
        wait = 12.0
    elif error:
        wait = min(168.0, 6.0 * 2 ** before["consecutive_errors"])
    else:
        wait = min(168.0, 12.0 * 2 ** min(before["consecutive_empty"], 4))
    mean = (before["avg_quality"] * (scans - 1) + batch_quality) / scans if before["avg_quality"] > 0 else batch_quality
    return {
        "total_scans": scans,
        "total_passed": before["total_passed"] + passed,
        "consecutive_empty": 0 if passed > 0 else before["consecutive_empty"] + (not error),
        "consecutive_errors": before["consecutive_errors"] + 1 if error else 0,
        "avg_quality": int(mean * 100 + 0.5) / 100,
        "next_hours": wait,
        "page_hash": page_hash or before["page_hash"],
        "passed": passed,
    }


#: What a fold keeps of a venue: the columns of :data:`HEALTH` without the venue, and what the last scan passed.
_HEALTH_STATE = HEALTH.split(", ", 1)[1] + ", passed long"


def after_scan(before: dict, passed: int, quality: float, outcome: str, page_hash: str | None) -> dict:
    """The state after a scan as it was read: a page with the hash of the one read last is unchanged, whatever was found on it."""
    if outcome != "error" and page_hash and page_hash == before["page_hash"]:
        outcome = "unchanged"
    ok = outcome == "ok"
    return next_health(before, int(passed) if ok else 0, quality if ok else 15.0, outcome, page_hash or None)


def _read_scans(scans: DataFrame) -> DataFrame:
    """The columns that the fold reads; numbers that are missing count as 0."""
    number = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    quality = F.coalesce(score.estimated_quality(number("found"), number("passed"), F.coalesce("source_url", F.lit(""))).cast("double"), F.lit(15.0))
    return scans.select("venue_id", "seq", number("passed").alias("passed"), quality.alias("quality"), F.coalesce("outcome", F.lit("error")).alias("outcome"), F.coalesce("page_hash", F.lit("")).alias("page_hash"))


def _row_of(venue: int, state: dict) -> dict:
    return {"venue_id": venue, **{k: v for k, v in state.items() if k != "passed"}}


def crawl_health(scans: DataFrame) -> DataFrame:
    """Each venue's state after its scans (venue_id, seq, passed, found, outcome, page_hash, source_url).

    The outcome is what the scan itself knows (ok, error, or another word for nothing
    found); whether the page had changed is seen here, by its hash.
    """

    def of_venues(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        venue, state, out = None, dict(_START), []
        for batch in batches:
            for row in batch.itertuples(index=False):
                if row.venue_id != venue:
                    if venue is not None:
                        out.append(_row_of(venue, state))
                    venue, state = row.venue_id, dict(_START)
                state = after_scan(state, row.passed, row.quality, row.outcome, row.page_hash)
            yield pd.DataFrame(out, columns=[c.split()[0] for c in HEALTH.split(", ")])
            out = []
        if venue is not None:
            yield pd.DataFrame([_row_of(venue, state)])

    ordered = _read_scans(scans).filter("venue_id IS NOT NULL").repartition("venue_id").sortWithinPartitions("venue_id", "seq")
    return ordered.mapInPandas(of_venues, HEALTH)


class VenueHealth(StatefulProcessor):
    """One venue's state, forgotten when the venue was not scanned for ``ttl_days``."""

    def __init__(self, ttl_days: int) -> None:
        self.ttl_days = ttl_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.health = handle.getValueState("health", _HEALTH_STATE, self.ttl_days * 86_400_000)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = dict(zip(_START_ORDER, self.health.get(), strict=True)) if self.health.exists() else dict(_START)
        for row in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            now = after_scan(now, row.passed, row.quality, row.outcome, row.page_hash)
        self.health.update(tuple(now[k] for k in _START_ORDER))
        yield pd.DataFrame([_row_of(key[0], now)])

    def close(self) -> None:
        pass


_START_ORDER = [c.split()[0] for c in _HEALTH_STATE.split(", ")]

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def crawl_health_stream(scans: DataFrame, ttl_days: int = 60) -> DataFrame:
    """The same on a stream of scans: one row of state per venue, emitted after every batch that has it.

    The session must keep state in RocksDB (``spark.sql.streaming.stateStore.providerClass``),
    which holds it outside the executors' memory and drops values whose time has passed.
    A query that is to end when all is read (``availableNow``) also needs
    ``spark.sql.streaming.noDataMicroBatches.enabled`` off: a time to live asks for further batches.
    """
    if not scans.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass").endswith("RocksDBStateStoreProvider"):
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    own = _read_scans(scans).filter("venue_id IS NOT NULL").groupBy("venue_id")
    return own.transformWithStateInPandas(VenueHealth(ttl_days), HEALTH, "Update", "ProcessingTime")


def with_cooldown(syncs: DataFrame) -> DataFrame:
    """Whether each sync of a cell came while the one before still rested it: two hours after a full one, a quarter after a thin one."""
    before = Window.partitionBy("grid_key").orderBy("synced_at", "id")
    last_at, last_n = F.lag("synced_at").over(before), F.lag("event_count").over(before)
    full = (last_n >= 20) & (F.col("synced_at") < last_at + hours(2))
    thin = last_n.between(1, 19) & (F.col("synced_at") < last_at + hours(0.25))
    return syncs.withColumn("cooling", F.coalesce(full | thin, F.lit(False)))


def refresh_states(actions: DataFrame) -> DataFrame:
    """(session_id, state, status, n_found, error) after a session's actions in order.

    A native fold over the ordered actions of a session; a session is short.
    """
    blank = F.struct(F.lit("idle").alias("state"), F.lit("").alias("status"), F.lit(0).alias("n_found"), F.lit(None).cast("string").alias("error"))

    def step(s, a):
        kind = a["type"]
        put = lambda **new: F.struct(*[new.get(f, s[f]).alias(f) for f in ("state", "status", "n_found", "error")])
        started = F.struct(F.lit("cooldown_check").alias("state"), F.lit("Reading your vibe…").alias("status"), F.lit(0).alias("n_found"), F.lit(None).cast("string").alias("error"))
        fresh = a["cell_fresh"]
        return (
            F.when(kind == "START", started)
            .when((kind == "COOLDOWN_RESULT") & ~a["user_allowed"] & fresh, put(state=F.lit("idle"), status=F.lit("")))
            .when(kind == "COOLDOWN_RESULT", put(state=F.when(fresh, "phase2").otherwise("phase1"), status=F.when(fresh, "Re-ranking for you…").otherwise("Searching the web…")))
            .when(kind == "STATUS", put(status=a["text"]))
            .when(kind == "FOUND_EVENT", put(n_found=s["n_found"] + 1))
            .when(kind == "STREAM_DONE", put(state=F.lit("phase2"), status=F.lit("Ranking picks for you…")))
            .when(kind == "RANK_RESULT", put(state=F.lit("done"), status=F.lit("")))
            .when(kind == "ERROR", put(state=F.lit("error"), error=a["message"]))
            .when(kind == "CANCEL", blank)
            .otherwise(s)
        )

    ordered = F.array_sort(F.collect_list(F.struct("seq", "type", "user_allowed", "cell_fresh", "text", "message")))
    return actions.groupBy("session_id").agg(ordered.alias("log")).select("session_id", F.aggregate("log", blank, step).alias("s")).select("session_id", "s.*")
