"""Receipts by session: the rules, a table against a plain loop, and a stream against the table."""

import random
from collections import OrderedDict
from datetime import datetime, timedelta

from evidencelake.streaming import sessions
from pyspark.sql import functions as F

SCHEMA = "session string, event_id long, ts timestamp, op string, item string, versions map<string,string>, units long"
START = datetime(2024, 1, 1)
STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def trace(seed, n=160):
    """Requests of two to three sources each; sources change their revision with a put."""
    rng, rows, revision = random.Random(seed), [], {}
    for i in range(n):
        s, at = rng.choice(["a", "a", "b", None]), START + timedelta(seconds=7 * i)
        op = rng.choices(["issue", "put", "link", "other"], [8, 1, 1, 0.3])[0]
        item, versions, units = f"s{rng.randrange(6)}", None, None
        if op == "put":
            revision[(s, item)] = f"r{i}"
        if op == "issue":
            root = rng.randrange(6)
            names = [f"s{(root + k) % 6}" for k in range(rng.choice([2, 2, 2]) + root % 2)]
            item, versions = f"q{root}", {x: revision.get((s, x), "r") for x in names}
            units = None if rng.random() < 0.1 else 100 * (root + 1)
            if rng.random() < 0.05:
                versions[names[0]] = "not that"
        rows.append((s, i, at, op, item, versions, units))
    return rows


def plain(rows, most_entries, most_bytes, seconds):
    """The rules told plainly: an ordered dict of receipts for each session, scanned whole at each step."""
    out, caches = {}, {}
    for s, i, at, op, item, versions, units in rows:
        cache, now, before = caches.setdefault(s, OrderedDict()), at.timestamp(), 0
        before = len(cache)
        for k in [k for k, (_, ends, _) in cache.items() if ends <= now]:
            del cache[k]
        outcome = "ignored"
        if op in ("put", "link"):
            outcome = "changed"
            for k in [k for k, (_, _, v) in cache.items() if item in v]:
                del cache[k]
        elif op == "issue" and item in cache:
            outcome = "unavailable" if any((versions or {}).get(x) != r for x, r in cache[item][2].items()) else "reused"
            if outcome == "reused":
                cache.move_to_end(item)
        elif op == "issue" and (units is None or units > most_bytes):
            outcome = "not_cached"
        elif op == "issue":
            outcome = "issued"
            while cache and (len(cache) >= most_entries or sum(u for u, _, _ in cache.values()) + units > most_bytes):
                cache.popitem(last=False)
            cache[item] = (units, now + seconds, versions)
        out[i] = (outcome, before - len(cache) + (outcome == "issued"), len(cache), sum(u for u, _, _ in cache.values()))
    return out


BOUNDS = {"most_entries": 3, "most_bytes": 1000, "seconds": 120.0}


def told(rows):
    return {r["event_id"]: (r["outcome"], r["dropped"], r["entries"], r["bytes"]) for r in rows}


def test_replay_equals_plain_rules(spark):
    for seed in (1, 2):
        rows = trace(seed)
        want = plain(rows, 3, 1000, 120)
        shuffled = random.Random(seed).sample(rows, len(rows))
        assert told(sessions.replay(spark.createDataFrame(shuffled, SCHEMA), **BOUNDS).collect()) == want
        assert {o[0] for o in want.values()} == {"issued", "reused", "changed", "not_cached", "unavailable", "ignored"}
    assert sessions.replay(spark.createDataFrame([], SCHEMA)).count() == 0


def test_stream_equals_replay_through_a_restart(spark, tmp_path):
    rows = trace(3, 120)
    last = ("z", 10_000, START + timedelta(days=1), "other", "x", None, None)  # moves the watermark past all others
    late = ("a", 20_000, START, "put", "s1", None, None)
    rng = random.Random(4)
    parts = [rows[:60], rows[60:]]
    old = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    partitions = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for n, part in enumerate([*parts, [last], [late, (None, 30_000, START + timedelta(days=2), "other", "x", None, None)]]):
            files = 3 if n < 2 else 1
            for k in range(files):
                some = rng.sample(part, len(part))[k::files] if n >= 2 else sorted(part, key=lambda r: rng.random())
                if n < 2:
                    some = [r for r in part if r[1] % 3 == k]
                    rng.shuffle(some)
                spark.createDataFrame(some, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            if n == 0:
                continue
            # the query ends after each round and goes on from its checkpoint
            stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            query = sessions.live(stream, late="1 hour", **BOUNDS).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            assert query.awaitTermination(120)
        got = told(spark.read.parquet(str(tmp_path / "out")).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set(STORE, old) if old else spark.conf.unset(STORE)
    want = told(sessions.replay(spark.createDataFrame(rows, SCHEMA), **BOUNDS).collect())
    assert 20_000 not in got and {i: v for i, v in got.items() if i < 10_000} == want
