"""Receipts of handoffs by session: reuse under capacity, bytes and time to live, dropped only where a mutation touches them.

Events are (session, event_id, ts, op, item, versions, units).  An ``issue`` asks for the packet of the request ``item``,
whose sources and their revisions are ``versions`` and whose size is ``units`` (null: the packet is not complete).  A
``put`` changes the source ``item``, a ``link`` adds an edge that starts there; both drop every receipt whose packet has
that source and no other.  A receipt is used again until its time is over; room is made by dropping the ones that were
used longest ago.

replay() folds a table, live() a stream.  Both go through Receipts, over plain dicts or over the state of a session; the
stream holds events back until the watermark passes them, so it gives what the table gives whatever the order in which
events arrive, but for those that come later than the watermark allows, which are left out.
"""

from __future__ import annotations

from collections.abc import Iterator, MutableMapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Default bounds of a session: receipts, bytes and seconds.
ENTRIES, BYTES, SECONDS = 128, 8 << 20, 300.0
#: What each event gives.
FIELDS = (("outcome", "string"), ("dropped", "int"), ("entries", "int"), ("bytes", "long"))


class Receipts:
    """A session's receipts over three mappings.

    ``kept``: request -> (units, ends, used, {source: revision}), where used counts up; ``by_source``: source -> list of
    requests; ``totals``: "bytes", "used" and "soonest", before which no receipt is over.
    """

    def __init__(self, kept: MutableMapping, by_source: MutableMapping, totals: MutableMapping, *, most_entries: int = ENTRIES, most_bytes: int = BYTES, seconds: float = SECONDS):
        self.kept, self.by_source, self.totals = kept, by_source, totals
        self.most_entries, self.most_bytes, self.span = most_entries, most_bytes, int(seconds * 1e6)

    def _drop(self, request: str) -> None:
        units, _, _, versions = self.kept[request]
        del self.kept[request]
        self.totals["bytes"] = self.totals.get("bytes", 0) - units
        for source in versions:
            left = [r for r in self.by_source[source] if r != request]
            if left:
                self.by_source[source] = left
            else:
                del self.by_source[source]

    def expire(self, now: int) -> int:
        if now < self.totals.get("soonest", 0):
            return 0  # no receipt is over before that
        ends = {r: e for r, (_, e, _, _) in self.kept.items()}
        over = [r for r, e in ends.items() if e <= now]
        for request in over:
            self._drop(request)
        self.totals["soonest"] = min((e for e in ends.values() if e > now), default=now + self.span)
        return len(over)

    def ends(self) -> int | None:
        """When the last receipt is over."""
        return max((ends for _, ends, _, _ in self.kept.values()), default=None)

    def event(self, now: int, op: str, item: str, versions: dict[str, str] | None, units: int | None) -> tuple[str, int, int, int]:
        """(outcome, receipts that were dropped, receipts and bytes after it) of one event; ``now`` in microseconds.

        Outcomes: reused, issued, not_cached (not complete, or larger than the session), unavailable (another revision
        than the receipt's), changed (put and link), ignored (another op).
        """
        gone = self.expire(now)
        if op in ("put", "link"):
            touched = list(self.by_source.get(item, []))
            for request in touched:
                self._drop(request)
            return self._told("changed", gone + len(touched))
        if op != "issue":
            return self._told("ignored", gone)
        used = self.totals.get("used", 0) + 1
        mine = self.kept.get(item)
        if mine is not None:
            size, ends, _, had = mine
            if any((versions or {}).get(s) != r for s, r in had.items()):
                return self._told("unavailable", gone)
            self.kept[item] = (size, ends, used, had)
            self.totals["used"] = used
            return self._told("reused", gone)
        if units is None or units > self.most_bytes:
            return self._told("not_cached", gone)
        while self.kept and (len(self.kept) >= self.most_entries or self.totals.get("bytes", 0) + units > self.most_bytes):
            self._drop(min(self.kept.items(), key=lambda e: e[1][2])[0])
            gone += 1
        self.kept[item] = (units, now + self.span, used, dict(versions or {}))
        for source in versions or {}:
            self.by_source[source] = [*self.by_source.get(source, []), item]
        self.totals["bytes"], self.totals["used"] = self.totals.get("bytes", 0) + units, used
        return self._told("issued", gone)

    def _told(self, outcome: str, dropped: int) -> tuple[str, int, int, int]:
        return outcome, dropped, len(self.kept), self.totals.get("bytes", 0)


def _columns(events: DataFrame) -> DataFrame:
    return events.select("session", F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"), "op", "item", F.col("versions").cast("map<string,string>").alias("versions"), F.col("units").cast("long").alias("units"))


def _told(events: DataFrame) -> str:
    return ", ".join([f"session {events.schema['session'].dataType.simpleString()}, event_id long", *(f"{n} {k}" for n, k in FIELDS)])


def replay(events: DataFrame, **bounds: float) -> DataFrame:
    """(session, event_id, outcome, dropped, entries, bytes) of a table of events, by session in order of ts and event_id.

    A session's events come sorted and in batches, of which only the live receipts are carried on; a session is in one
    task, as its events depend on each other.  Null sessions are one session; null op or an unknown one is ignored.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, state = fold, None  # no session, not even null
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                if row["session"] != before:
                    before, state = row["session"], Receipts({}, {}, {}, **bounds)
                out.append(state.event(row["at"], row["op"], row["item"], dict(row["versions"]) if row["versions"] is not None else None, row["units"]))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64())
            made = [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch["session"], batch["event_id"], *made], names=["session", "event_id", *(n for n, _ in FIELDS)])

    rows = _columns(events).withColumn("at", F.unix_micros("ts")).drop("ts")
    dealt = rows.repartition("session").sortWithinPartitions("session", "at", "event_id")
    return dealt.mapInArrow(fold, _told(events))


class Held(MutableMapping):
    """A map state of string keys as a mapping: ``read`` and ``write`` turn values into the state's rows and back."""

    def __init__(self, state, read, write):
        self.state, self.read, self.write = state, read, write

    def __getitem__(self, key: str):
        row = self.state.getValue((key,))
        if row is None:
            raise KeyError(key)
        return self.read(row)

    def __setitem__(self, key: str, value) -> None:
        self.state.updateValue((key,), self.write(value))

    def __delitem__(self, key: str) -> None:
        self.state.removeKey((key,))

    def __iter__(self):
        return iter([k[0] for k in self.state.keys()])

    def items(self):
        """All at once, and not key by key."""
        return [(k[0], self.read(row)) for k, row in self.state.iterator()]

    def values(self):
        return [v for _, v in self.items()]

    def __len__(self) -> int:
        return sum(1 for _ in self.state.keys())


class SessionProcessor(StatefulProcessor):
    """Holds a session's events back until the watermark passes them, then takes them in order.

    State: the events in waiting, the receipts, the reverse index from sources to requests, and totals.  A timer at each
    waiting event's time takes it up; one at the end of the last receipt clears an idle session's state.
    """

    def __init__(self, bounds: dict[str, float]):
        self.bounds = bounds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "at long, event_id long", "op string, item string, versions map<string,string>, units long")
        kept = Held(handle.getMapState("receipts", "request string", "units long, ends long, used long, versions map<string,string>"), lambda r: (r[0], r[1], r[2], dict(r[3])), tuple)
        by_source = Held(handle.getMapState("sources", "source string", "requests array<string>"), lambda r: list(r[0]), lambda v: (v,))
        totals = Held(handle.getMapState("totals", "name string", "n long"), lambda r: r[0], lambda v: (v,))
        self.receipts = Receipts(kept, by_source, totals, **self.bounds)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for part in rows:
            for row in part.itertuples(index=False):
                at = row.ts.value // 1000 if row.ts.tzinfo is None else row.ts.tz_convert("UTC").value // 1000
                versions = None if row.versions is None else dict(row.versions)
                self.waiting.updateValue((int(at), int(row.event_id)), (row.op, row.item, versions, None if pd.isna(row.units) else int(row.units)))
                self.handle.registerTimer(at // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = expiredTimerInfo.getExpiryTimeInMs()
        due = sorted(k for k in map(tuple, self.waiting.keys()) if k[0] // 1000 + 1 <= upto)
        out = []
        for at, event_id in due:
            op, item, versions, units = self.waiting.getValue((at, event_id))
            self.waiting.removeKey((at, event_id))
            out.append((key[0], event_id, *self.receipts.event(at, op, item, dict(versions) if versions is not None else None, units)))
        if not due:
            self.receipts.expire(upto * 1000)
        if (ends := self.receipts.ends()) is not None and ends // 1000 + 1 > upto:
            self.handle.registerTimer(ends // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=["session", "event_id", *(n for n, _ in FIELDS)])

    def close(self) -> None:
        pass


def live(events: DataFrame, *, late: str = "10 minutes", **bounds: float) -> DataFrame:
    """replay() of a stream of events, appended as the watermark, ``late`` behind the newest event, passes them.

    Needs the RocksDB state store.  State is what waits and what lives: receipts go when they are dropped or over.
    """
    timed = _columns(events).withWatermark("ts", late)
    return timed.groupBy("session").transformWithStateInPandas(SessionProcessor(bounds), _told(events), "append", "eventTime")
