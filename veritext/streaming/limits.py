"""Fixed-window rate limits per client, as a batch and as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


REQUESTS, SECONDS = 120, 60.0
SCHEMA = "client string, bucket string, ts timestamp_ntz, place int, allowed boolean"


def decide(times: list[float], start: float | None, used: int, requests: int, seconds: float) -> tuple[list[tuple[int, bool]], float | None, int]:
    """Place in its window and verdict of each request. A window starts at its first request, not on the clock."""
    out = []
    for t in times:
        if start is None or t - start >= seconds:
            start, used = t, 0
        used += 1
        out.append((used, used <= requests))
    return out, start, used


def limit(events: DataFrame, requests: int = REQUESTS, seconds: float = SECONDS) -> DataFrame:
    """client, bucket, ts, place, allowed over events (client, bucket, ts)."""
    def run(batches):
        key, start, used = None, None, 0  # the window of the client that the batch before ended with
        for batch in batches:
            held = batch.to_pylist()
            out = []
            for r in held:
                if (r["client"], r["bucket"]) != key:
                    key, start, used = (r["client"], r["bucket"]), None, 0
                ((place, ok),), start, used = decide([r["ts"].timestamp()], start, used, requests, seconds)
                out.append((place, ok))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([p for p, _ in out], pa.int32()), pa.array([ok for _, ok in out], pa.bool_())], [*batch.schema.names, "place", "allowed"])

    # A client's requests pass in order; its state is one window, however many there are.
    return events.select("client", "bucket", "ts").repartition("client", "bucket").sortWithinPartitions("client", "bucket", "ts").mapInArrow(run, SCHEMA)


def limit_stream(events: DataFrame, requests: int = REQUESTS, seconds: float = SECONDS, late: str = "10 minutes") -> DataFrame:
    """The same over a stream with event time ts, late by at most `late`; the state of a client is its window's start and count, dropped once the watermark is past the window."""
    import pandas as pd

    def update(key, batches: Iterator[pd.DataFrame], state):
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (None, 0)
        held = pd.concat(list(batches)).sort_values("ts")
        places, start, used = decide([t.timestamp() for t in held["ts"]], start, used, requests, seconds)
        state.update((start, used))
        state.setTimeoutTimestamp(max(int((start + seconds) * 1000), state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"client": key[0], "bucket": key[1], "ts": held["ts"].to_numpy(), "place": [p for p, _ in places], "allowed": [ok for _, ok in places]})

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)  # a watermark needs this kind of time
    out = timed.groupBy("client", "bucket").applyInPandasWithState(update, SCHEMA.replace("timestamp_ntz", "timestamp"), "start double, used int", "append", "EventTimeTimeout")
    return out.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def index_new_documents(stream: DataFrame, index_path: str, checkpoint: str, id_col: str = "doc_id", text_col: str = "text"):
    """Adds new documents to an index, a batch of it for each batch of the stream, and ends when all are in (Trigger.AvailableNow).

    A batch that is replayed after a failure replaces what it wrote before; search_index reads all batches."""
    from veritext.operators.retrieval import add_to_index

    def add(batch: DataFrame, number: int) -> None:
        add_to_index(batch, index_path, number + 1, id_col, text_col)  # batch 0 is that of write_index

    return stream.writeStream.foreachBatch(add).trigger(availableNow=True).option("checkpointLocation", checkpoint).start()
