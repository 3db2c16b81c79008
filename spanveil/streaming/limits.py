"""Failure limiter with state per client, as a stream and over a table; jobs that fall due; redaction of arriving documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from spanveil import api
from spanveil.operators.jobs import FAILURES, OPEN, SECONDS
from spanveil.session import ship

DECISIONS = "client string, seq long, at double, ok boolean, decision string"
_STATE = "times array<double>"


def decide(times: list[float], rows: list[tuple[float, bool]], seconds: float = SECONDS, limit: int = FAILURES) -> tuple[list[str], list[float]]:
    """Decisions on attempts in time order, and the failures still remembered.

    A client with `limit` failures in the trailing window is refused, valid key or not. Refused attempts are not recorded
    and a success does not reset the count.
    """
    out = []
    for at, ok in rows:
        times = [t for t in times if t > at - seconds]
        if len(times) >= limit:
            out.append("limited")
        elif ok:
            out.append("accepted")
        else:
            out.append("rejected")
            times.append(at)
    return out, times


def limiter(attempts: DataFrame, seconds: float = SECONDS, limit: int = FAILURES, late: str = "1 minute") -> DataFrame:
    """Stream of attempts (client, seq, at in seconds, ok) -> the same with `decision`.

    State is at most `limit` times a client, dropped when the event time has passed a client's last attempt by the window. Attempts
    that come `late` behind the newest one seen get no decision, as no order is left to judge them in. A task holds one client's attempts of one
    micro-batch; maxFilesPerTrigger, or the source's like, bounds them. Over a table `decisions` streams a client's history instead.
    """
    ship(attempts.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(batches)).sort_values(["at", "seq"], kind="stable")
        decisions, times = decide(times, list(zip(rows["at"], rows["ok"])), seconds, limit)
        state.update((times,))
        state.setTimeoutTimestamp(max(int((rows["at"].iloc[-1] + seconds) * 1000), state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"client": key[0], "seq": rows["seq"], "at": rows["at"], "ok": rows["ok"], "decision": decisions})

    timed = attempts.select("client", "seq", "at", "ok", F.timestamp_micros((F.col("at") * 1_000_000).cast("long")).alias("ts")).withWatermark("ts", late)
    return timed.groupBy("client").applyInPandasWithState(step, DECISIONS, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def history_pieces(attempts: DataFrame, seconds: float = SECONDS) -> DataFrame:
    """attempts (client, seq, at, ok) with `piece`, the parts of a client's history between which nothing is remembered; null where nothing is remembered at all.

    Time is cut into slices as long as the window. A slice without failures parts those before it from those behind it, so runs of slices with
    failures are pieces; the slice behind a run still looks back into it. The window over slices has one row a slice with failures.
    """
    sliced = attempts.withColumn("__slice", F.floor(F.col("at") / F.lit(float(seconds))).cast("long"))
    active = sliced.where("NOT ok").select("client", "__slice").distinct()
    by = Window.partitionBy("client").orderBy("__slice")
    fresh = F.coalesce(F.col("__slice") - F.lag("__slice").over(by) > 1, F.lit(True))
    runs = active.withColumn("__fresh", fresh).withColumn("piece", F.max(F.when(F.col("__fresh"), F.col("__slice"))).over(by))
    reach = runs.select("client", F.explode(F.array(F.col("__slice"), F.col("__slice") + 1)).alias("__slice"), "piece")
    reach = reach.groupBy("client", "__slice").agg(F.max("piece").alias("piece"))
    return sliced.join(reach, ["client", "__slice"], "left").drop("__slice")


def _fold(seconds: float, limit: int):
    """Arrow function over rows (client, piece, seq, at, ok) in order -> decisions; `limit` times are remembered."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, times = None, []
        for batch in batches:
            client, piece, seq, at, ok = (batch.column(k).to_pylist() for k in range(5))
            out: list[str] = []
            for c, p, t, good in zip(client, piece, at, ok):
                if (c, p) != now:
                    now, times = (c, p), []
                decision, times = decide(times, [(t, good)], seconds, limit)
                out += decision
            yield pa.record_batch([batch.column(0), batch.column(2), batch.column(3), batch.column(4), pa.array(out, pa.string())], names=["client", "seq", "at", "ok", "decision"])

    return fold


def decisions(attempts: DataFrame, seconds: float = SECONDS, limit: int = FAILURES) -> DataFrame:
    """attempts (client, seq, at in seconds, ok) of a table with `decision`, as the stream decides them.

    Refused attempts are not recorded, so a count depends on the decisions before it. Histories are cut where nothing is remembered, and their pieces
    folded in parallel, each streamed in order with `limit` times in memory. A null `ok` is a failure; a client's attempts are ordered by (at, seq).
    """
    ship(attempts.sparkSession)
    own = attempts.select("client", "seq", F.col("at").cast("double").alias("at"), F.coalesce("ok", F.lit(False)).alias("ok"))
    pieces = history_pieces(own, seconds)
    schema = ", ".join(f"{c} {own.schema[c].dataType.simpleString()}" for c in ("client", "seq", "at", "ok")) + ", decision string"
    free = pieces.where("piece IS NULL").select("client", "seq", "at", "ok", F.lit("accepted").alias("decision"))  # no failure is near, nor are they one
    rest = pieces.where("piece IS NOT NULL").repartition("client", "piece").sortWithinPartitions("client", "piece", "at", "seq")
    return free.unionByName(rest.select("client", "piece", "seq", "at", "ok").mapInArrow(_fold(seconds, limit), schema))


def failures_per_window(attempts: DataFrame, width: str = "10 minutes", slide: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """Failures of each client in sliding windows of event time; later rows than the watermark allows are dropped."""
    return attempts.withWatermark("ts", late).where("NOT ok").groupBy(F.window("ts", width, slide), "client").agg(F.count("*").alias("failures"))


def expire(events: DataFrame, late: str = "1 minute") -> DataFrame:
    """Stream of job events (job_id, ts, status, expires) -> (job_id, expires) of each job that falls due, once.

    A job is due when the event time has passed its `expires` and it is neither queued nor running; one that ends later is due then. The
    newest event of a job counts; a deleted job is forgotten.
    """
    ship(events.sparkSession)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            at = state.get[0]
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "expires": [pd.Timestamp(at, unit="us")]})
            return
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        last = rows.iloc[-1]
        micros = int(pd.Timestamp(last["expires"]).value // 1000)
        if last["status"] == "deleted":
            if state.exists:
                state.remove()
            return
        newest = int(pd.Timestamp(last["ts"]).value // 1000)
        if state.exists and state.get[1] > newest:
            return
        state.update((micros, newest))
        if last["status"] not in OPEN:
            state.setTimeoutTimestamp(max(micros // 1000, state.getCurrentWatermarkMs()) + 1)

    timed = events.select("job_id", "ts", "status", "expires").withWatermark("ts", late)
    return timed.groupBy("job_id").applyInPandasWithState(step, "job_id string, expires timestamp", "expires long, newest long", "append", GroupStateTimeout.EventTimeTimeout)


def redact_stream(docs: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, options: api.Options = api.Options()):  # noqa: B008 - frozen
    """Redact whole documents (doc_id, text) as they arrive: each micro-batch goes through `api.run`, propagation included."""
    ship(docs.sparkSession)

    def batch(rows: DataFrame, number: int) -> None:
        write(api.run(rows, options).lines, number)

    return docs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
