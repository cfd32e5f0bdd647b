"""Receipts and result reuse over event order: batch replay, and stateful streams with time to live."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.lifecycle import shared


def replay(events: DataFrame, mutation: Column, *, key: str = "user_id") -> DataFrame:
    """Add ``m``, ``hit_selective`` and ``hit_global`` to events(event_id, ts, key): whether a handoff finds its receipt.

    A receipt of the key is there if a handoff came since the last mutation of that key; under global invalidation,
    since the last mutation of any key.  The latter's time comes from running maxima within ranges of time that hold
    about as many events each, and one over the ranges (a row each), so that no window holds all events or a busy hour.
    """
    at = F.struct(F.col("ts").cast("timestamp").alias("ts"), "event_id")
    marked = events.withColumn("m", mutation).withColumn("__at", at)
    ranged = shared(marked.repartitionByRange("ts", "event_id").withColumn("__range", F.spark_partition_id()))
    last = lambda when, over: F.max(F.when(when, F.col("__at"))).over(over)
    within = Window.partitionBy("__range").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("__range").agg(F.max(F.when(F.col("m"), F.col("__at"))).alias("__top"))
    before = ranges.select("__range", F.max("__top").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    timed = ranged.withColumn("__within", last(F.col("m"), within)).join(F.broadcast(before), "__range")
    earlier = Window.partitionBy(key).orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    mine = timed.withColumn("__handoff", last(~F.col("m"), earlier)).withColumn("__mutation", last(F.col("m"), earlier))
    hit = lambda since: ~F.col("m") & F.coalesce(F.col("__handoff").isNotNull() & (since.isNull() | (F.col("__handoff") > since)), F.lit(False))
    told = mine.withColumn("hit_selective", hit(F.col("__mutation"))).withColumn("hit_global", hit(F.coalesce("__within", "__before")))
    return told.drop("__at", "__range", "__handoff", "__mutation", "__within", "__before")


def recent(outcomes: DataFrame, by: str, *order: str, most: int = 128) -> DataFrame:
    """The newest ``most`` rows of each key, the newest first, with their ``place``."""
    newest = Window.partitionBy(by).orderBy(*[F.col(c).desc() for c in order])
    return outcomes.withColumn("place", F.row_number().over(newest)).where(F.col("place") <= most)


def context_changed(calls: DataFrame, mutations: DataFrame) -> DataFrame:
    """Add ``changed`` to calls(call_id, key, began, ended): a mutation(key, at) of the key came after it began and by its end.

    Mutations are counted up to both ends of each call in one ordered pass by key, not joined by range.
    """
    end = lambda kind, at: calls.select("key", F.col(at).alias("at"), F.lit(1).alias("last"), F.lit(0).alias("n"), "call_id", F.lit(kind).alias("end"))
    ticks = mutations.select("key", "at", F.lit(0).alias("last"), F.lit(1).alias("n"), F.lit(None).cast(calls.schema["call_id"].dataType).alias("call_id"), F.lit(None).cast("string").alias("end"))
    line = ticks.unionByName(end("b", "began")).unionByName(end("e", "ended"))
    upto = Window.partitionBy("key").orderBy("at", "last").rowsBetween(Window.unboundedPreceding, 0)
    counted = line.withColumn("seen", F.sum("n").over(upto)).where("end is not null")
    ends = counted.groupBy("call_id").agg(F.max(F.when(F.col("end") == "b", F.col("seen"))).alias("b"), F.max(F.when(F.col("end") == "e", F.col("seen"))).alias("e"))
    return calls.join(ends.select("call_id", (F.col("e") > F.col("b")).alias("changed")), "call_id")


def reuse(requests: DataFrame, identity: Column, size: Column, *order: str) -> DataFrame:
    """(identity, n, hits, saved): exact result reuse; all but the first request of an identity are hits."""
    named = requests.select(identity.alias("identity"), size.alias("bytes"))
    return named.groupBy("identity").agg(F.count("*").alias("n"), (F.count("*") - 1).alias("hits"), ((F.count("*") - 1) * F.max("bytes")).alias("saved"))


#: Fixed value: bytes of a receipt.
RECEIPT = 32


def accounting(handoffs: DataFrame, hits: dict[str, Column], units: Column) -> DataFrame:
    """(method, handoffs, hits, transfer, resolved): what each way of reuse moves, a row for each.

    ``hits`` names the ways and says whether a handoff found its receipt; null stands for no receipts at all.  A hit moves
    a receipt, a miss the packet and a receipt, and a way without receipts the packet alone; what is resolved is the
    packets' bytes in any case.
    """
    ways = [F.struct(F.lit(n).alias("method"), h.cast("boolean").alias("hit")) for n, h in hits.items()]
    each = handoffs.select(units.cast("long").alias("units"), F.explode(F.array(*ways)).alias("w")).select("units", "w.*")
    moved = F.when(F.col("hit").isNull(), F.col("units")).when(F.col("hit"), RECEIPT).otherwise(F.col("units") + RECEIPT)
    return each.groupBy("method").agg(F.count("*").alias("handoffs"), F.count_if(F.coalesce("hit", F.lit(False))).alias("hits"), F.sum(moved).alias("transfer"), F.sum("units").alias("resolved"))


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, start, n) of session windows; works on a stream (closed sessions are appended) and on a table.

    ``ts`` may lack a time zone: watermarks need a timestamp with one, and the session's zone is taken.
    """
    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), "n")


def lru_hit(kept: dict[str, tuple[float, int]], item: str, now: float, capacity: int, ttl_seconds: float, size: int = 0, most_bytes: int | None = None) -> bool:
    """Whether ``item`` is in the cache at ``now``; ``kept`` (item to its time and bytes, oldest use first) is brought up to date.

    What is larger than the whole cache is not kept.
    """
    for k in [k for k, (t, _) in kept.items() if now - t >= ttl_seconds]:
        del kept[k]
    made = kept.pop(item, None)
    if made is not None or most_bytes is None or size <= most_bytes:
        kept[item] = made or (now, size)
    while len(kept) > capacity or (most_bytes is not None and sum(b for _, b in kept.values()) > most_bytes):
        kept.pop(next(iter(kept)))
    return made is not None


def lru_hits(events: pd.DataFrame, capacity: int, ttl_seconds: float) -> pd.DataFrame:
    """One principal's cache: events(event_id, ts, item) in order give hit flags under capacity and time to live."""
    events, kept = events.sort_values(["ts", "event_id"]), {}
    return events.assign(hit=[lru_hit(kept, row.item, row.ts.timestamp(), capacity, ttl_seconds) for row in events.itertuples()])


def ttl_lru(events: DataFrame, *, capacity: int = 2, ttl_seconds: float = 86_400.0, most_bytes: int | None = None) -> DataFrame:
    """(principal, event_id, hit) from events(principal, event_id, ts, item, and bytes if they are bounded): an ordered fold per principal.

    A principal's events come sorted and in batches, and between batches only its live cache is kept, so memory does
    not grow with the events of a principal.  The fold itself is in order: a principal is in one task.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before: object = fold  # no principal, not even null
        kept: dict[str, tuple[float, int]] = {}
        for batch in batches:
            principals, hits = batch["principal"].to_pylist(), []
            times = batch["at"].to_pylist()
            for principal, item, at, size in zip(principals, batch["item"].to_pylist(), times, batch["bytes"].to_pylist(), strict=True):
                if principal != before:
                    before, kept = principal, {}
                hits.append(lru_hit(kept, item, at / 1e6, capacity, ttl_seconds, size, most_bytes))
            yield pa.RecordBatch.from_arrays([batch["principal"], batch["event_id"], pa.array(hits, pa.bool_())], names=["principal", "event_id", "hit"])

    size = F.col("bytes").cast("long") if "bytes" in events.columns else F.lit(0).cast("long")
    timed = events.select("principal", "event_id", "item", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), size.alias("bytes"))
    dealt = timed.repartition("principal").sortWithinPartitions("principal", "at", "event_id")
    kind = {c: events.schema[c].dataType.simpleString() for c in ("principal", "event_id")}
    return dealt.mapInArrow(fold, f"principal {kind['principal']}, event_id {kind['event_id']}, hit boolean")


def stream_receipts(events: DataFrame, *, ttl: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """The same as a stream without capacity: events(principal, event_id, ts, item) give (principal, event_id, hit).

    State is one principal's live receipts; it goes when event time passes the last one's end.
    """
    seconds = pd.Timedelta(ttl).total_seconds()

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        items, made = state.get if state.exists else ([], [])
        kept = dict(zip(items, made, strict=True))
        for part in parts:
            part = part.sort_values(["ts", "event_id"])
            hits = []
            for row in part.itertuples():
                now = row.ts.timestamp()
                kept = {k: t for k, t in kept.items() if now - t < seconds}
                hits.append(row.item in kept)
                kept.setdefault(row.item, now)
            yield part.assign(hit=hits)[["principal", "event_id", "hit"]]
        state.update((list(kept), list(kept.values())))
        end = int(max(kept.values(), default=0) + seconds) * 1000
        state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))

    timed = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return timed.groupBy("principal").applyInPandasWithState(
        step, f"principal {events.schema['principal'].dataType.simpleString()}, event_id {events.schema['event_id'].dataType.simpleString()}, hit boolean", "items array<string>, made array<double>", "append", GroupStateTimeout.EventTimeTimeout
    )
