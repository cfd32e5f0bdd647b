"""Portable payloads and packet chunks against the standard library's JSON."""

import json
import random

from evidencelake.operators import payloads
from pyspark.sql import functions as F

STAMP = "cs1:" + "ab" * 32 + ":16:6f5e"


def told(spark, column, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", column.alias("x"))
    return [r["x"] for r in rows.orderBy("i").collect()]


def test_strings_as_json_has_them(spark):
    rng = random.Random(1)
    texts = ["", "plain", 'a"b\\c', "é中🙂\x7f", "\x00\x1f\b\t\n\f\r/", "</script>\u2028"] + ["".join(rng.choice('ab"\\é🙂\n\x01 ') for _ in range(12)) for _ in range(60)]
    assert told(spark, payloads.json_string(F.col("t")), [*texts, None]) == [*map(json.dumps, texts), None]
    assert told(spark, payloads.json_string(F.col("t"), ascii_only=False), texts) == [json.dumps(t, ensure_ascii=False) for t in texts]


def strict(text):
    """What a portable text holds, by the standard library; None for a refusal."""

    def once(pairs):
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError
        return dict(pairs)

    import re

    try:
        if len(text.encode()) > 8192:
            return None
        got = json.loads(text, object_pairs_hook=once)
        views = got["views"]
        fine = set(got) == {"format", "views"} and got["format"] == "scqr1" and isinstance(views, dict) and 1 <= len(views) <= 8
        fine = fine and all(re.fullmatch(r"[a-z][a-z0-9_]{0,31}", n) and isinstance(s, str) and re.fullmatch(r"cs1:[0-9a-f]{64}:16:[0-9a-f]{4}", s) for n, s in views.items())
        return views if fine else None
    except (ValueError, KeyError, TypeError, AttributeError):
        return None


def test_portable_payloads(spark):
    good = json.dumps({"format": "scqr1", "views": {"b": STAMP, "a": STAMP}})
    views = lambda n: {f"v{i}": STAMP for i in range(n)}
    whole = lambda **more: json.dumps({"format": "scqr1", "views": {"a": STAMP}} | more)
    texts = [
        good, f"\n {good}\t", good + " x", good + good, good + "],[" + good, good + "}} x", good + "}", good + "]", good + ",1", good + '}, "q": {"x": 1}',
        '{"format":"scqr1","format":"scqr1","views":{"a":"%s"}}' % STAMP, '{"format":"scqr1","views":{"a":"%s","a":"%s"}}' % (STAMP, STAMP), '{"format":"scqr1","views":{"a":"%s","\\u0061":"%s"}}' % (STAMP, STAMP),
        whole(extra=1), whole(format="scqr2"), whole(format=1), whole(views={}), whole(views=["a"]), whole(views=None), whole(views={"a": 1}), whole(views={"A": STAMP}), whole(views={"a": STAMP[:-1]}), whole(views={"a": {"x": STAMP}}),
        whole(views=views(8)), whole(views=views(9)), "", "[]", "null", "{", "{'format':'scqr1'}", '{"views":{"a":"%s"}, "format":"scqr1"}' % STAMP, '{"format":"scqr1"}',
        good + " " * (8192 - len(good)), good + " " * (8193 - len(good)), '{"format":"scqr1","views":{"a":"%s"},}' % STAMP, '\ufeff' + good,
    ]
    assert told(spark, payloads.parse_portable(F.col("t")), [*texts, None]) == [*map(strict, texts), None]
    want = json.dumps({"format": "scqr1", "views": {"a": STAMP, "b": STAMP}}, sort_keys=True, separators=(",", ":"))
    assert told(spark, payloads.canonical(payloads.parse_portable(F.col("t"))), texts[:1]) == [want]
    assert told(spark, payloads.portable({"b": F.col("t"), "a": F.col("t")}), [STAMP, None]) == [want, None]


def test_chunks_round_trip(spark):
    rows = [('a/"b\\é', "d1", "text\nmore\n\nlast"), ("x\ny", "d2", "")]
    frame = spark.createDataFrame(rows, "s string, d string, t string")
    chunk = payloads.evidence_chunk(F.col("s"), F.col("d"), F.col("t"))
    got = frame.select(chunk.alias("c"), payloads.handoff_header(F.col("s"), F.lit("r"), F.col("d")).alias("h")).withColumn("f", payloads.chunk_fields(F.col("c"))).collect()
    for r, (s, d, t) in zip(got, rows):
        assert r["c"] == json.dumps({"source": s, "sha256": d}, ensure_ascii=False) + "\n" + t
        assert r["h"] == json.dumps({"source": s, "revision": "r", "sha256": d}, sort_keys=True) + "\n"
        assert r["f"]["fields"] == {"source": s, "sha256": d} and r["f"]["text"] == t
    assert told(spark, payloads.chunk_fields(F.col("t")), ['{"a":1}\nx', "no header", "[]\nx"]) == [None] * 3


def test_identities(spark):
    import hashlib

    import pytest
    from evidencelake.operators.stamps import Family

    digest = "ab" * 32
    good = [("b", "r\u00e9", digest), ("a", 'r"', digest)]
    cases = [(digest, good), (digest.upper(), good), (digest, []), (digest, good + [("a", "r2", digest)]), (digest, [("a", "r", "short")]), (digest, [("", "r", digest)]), (digest, [("a\n", "r", digest)]), (digest, [(f"s{i}", "r", digest) for i in range(129)]), (None, good), (digest, None)]
    frame = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, request string, sources array<struct<id:string,revision:string,digest:string>>")
    parts = {n: F.lit(f"{n} x") for n in payloads.NAMED}
    got = [r["x"] for r in frame.select("i", payloads.computation_identity(parts, F.col("request"), F.col("sources")).alias("x")).orderBy("i").collect()]
    whole = {**{n: f"{n} x" for n in payloads.NAMED}, "request": digest, "sources": sorted(good)}
    assert got == [hashlib.sha256(json.dumps(whole, sort_keys=True, separators=(",", ":")).encode()).hexdigest()] + [None] * 9
    families = {"b": Family("e", 3, 16), "a": Family("f", 3, 16)}
    scope = payloads.policy_scope("app", families, {"a": 1.0, "b": 3.0})
    assert scope.startswith("facet-query:") and scope == payloads.policy_scope("app", families, {"a": 2, "b": 6}) != payloads.policy_scope("app", families, {"a": 1, "b": 1})
    with pytest.raises(ValueError):
        payloads.policy_scope("app", families, {"a": 1.0})
    assert payloads.profile_identity("zscore", 0.75) == hashlib.sha256(b'{"normalization":"zscore","semantic_weight":0.75}').hexdigest()
