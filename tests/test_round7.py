import math

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import functions as F

from evidencelake import plans
from evidencelake.operators import evaluation, payloads


def same_as_sql(spark, folder, name):
    """The query's rows and those of its SQL over the tables in a folder, sorted."""
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    want = con.execute(plans.ORACLES[name])
    columns = [c[0] for c in want.description]
    got = [tuple(r) for r in plans.QUERIES[name](spark, str(folder)).select(*columns).collect()]
    rows = lambda found: sorted(found, key=lambda r: [(x is not None, x) for x in r])
    return rows(got), rows(want.fetchall())


def gain(n, words, size):
    return 0.01 + 0.25 * ((math.log(1 + n) - 5.0) / 0.9) - 0.5 * ((words / n - 0.6) / 0.2) + 0.125 * ((size / 65536 - 0.05) / 0.08)


def test_expert_router_on_its_threshold(spark, tmp_path):
    texts = []
    for n in range(200, 400):  # texts of n tokens whose gain is as near the threshold as a byte more or less brings it
        words = next(w for w in range(n, 0, -1) if gain(n, w, 2 * n) >= 0.02 - 0.05)
        size = round((0.02 - gain(n, words, 0)) / (0.125 / 0.08 / 65536))
        plain = " ".join([chr(0x4E00 + i) for i in range(words)] + [chr(0x4E00)] * (n - words))
        if size >= len(plain.encode()) and abs(gain(n, words, size) - 0.02) < 6e-6:
            texts.append(plain + "." * (size - len(plain.encode())))
    assert len(texts) > 3
    ids, sources = list(range(len(texts) + 3)), ["src0"] * len(texts) + [None, None, "src4"]
    texts += [texts[0], None, "of no approved source"]
    pq.write_table(pa.table({"doc_id": ids, "text": texts, "lang": ["en"] * len(ids), "source": sources}), tmp_path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": ids, "quality": pa.array([1] * len(ids), pa.int32())}), tmp_path / "labels.parquet")
    got, want = same_as_sql(spark, tmp_path, "q69_expert_router")
    assert got == want and {r[1] for r in got} == {"hybrid", "fusion"}


def test_restoration_gain_shuffles_lines_once(spark, tmp_path):
    flags = ["A", "N", "R", None]
    rows = [(k, n % (2 + k % 6) + 1, flags[(k * 7 + n * n) % (4 if k % 9 == 0 else 3)], "FO"[(k + n) % 2]) for k in range(200) for n in range(1 + k % 8)]
    rows += [(1000, n % 7 + 1, flags[n % 3], "FO"[n % 2]) for n in range(3000)] + [(None, 1, "A", "F"), (1001, 1, None, None), (1002, 3, "A", "F")]
    columns = list(zip(*rows))
    kinds = {"l_orderkey": pa.int64(), "l_linenumber": pa.int32(), "l_returnflag": pa.string(), "l_linestatus": pa.string()}
    pq.write_table(pa.table({n: pa.array(c, t) for c, (n, t) in zip(columns, kinds.items())}), tmp_path / "lineitem.parquet")
    got, want = same_as_sql(spark, tmp_path, "q68_restoration_gain")
    assert got == want
    plan = plans.QUERIES["q68_restoration_gain"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_restoration_gain_of_required_facts(spark):
    rows = [(c, s, f, (c + s) % 4 == 0) for c in range(30) for s in range(5) for f in range(6) if (c * 31 + s * 17 + f * f * 7) % 5 < 2]
    needed = [(c, f) for c in range(1, 32) for f in range(7) if (c + f) % 3 and (f < 6 or c % 5 == 0)]
    frames = spark.createDataFrame(rows, "case long, source long, fact long, stale boolean"), spark.createDataFrame(needed + needed[:9], "case long, fact long")
    want = set()
    for c in {r[0] for r in rows}:
        facts, needs = {}, {f for k, f in needed if k == c}
        for k, s, f, stale in rows:
            if k == c:
                facts.setdefault(s, set()).update([] if stale else [f])
        for omitted in needs:
            background = set().union(*[fs for fs in facts.values() if omitted not in fs])
            for s, fs in facts.items():
                before, after = (int(needs <= have) for have in (background, background | fs))
                want.add((c, omitted, s, before, after, after - before))
    got = [tuple(r) for r in evaluation.restoration_gain(*frames).collect()]
    assert set(got) == want and len(got) == len(want) and {r[4] for r in got} == {0, 1}


def test_portable_payloads_are_parsed_once_a_way(spark, tmp_path):
    rows = [(i, t, s) for i, (t, s) in enumerate([("a", "src0"), ("", "src1"), (None, "src2"), ("é\n\"x\"", None), ("b" * 9000, "")])]
    pq.write_table(pa.table(dict(zip(("doc_id", "text", "source"), map(list, zip(*rows))))), tmp_path / "documents.parquet")
    frame = plans.QUERIES["q82_portable_payload"](spark, str(tmp_path))
    assert frame._jdf.queryExecution().optimizedPlan().toString().count("parseJson") == 2
    got, want = same_as_sql(spark, tmp_path, "q82_portable_payload")
    whole = {r[0] for r in rows if None not in r}
    assert [r for r in got if r[0] in whole] == [r for r in want if r[0] in whole] and len(got) == len(want)


def test_portable_payload_with_blanks_around(spark):
    stamp = "cs1:" + "a" * 64 + ":64:" + "0" * 16
    plain = f'{{"format":"scqr1","views":{{"v":"{stamp}"}}}}'
    good = [plain, f"  {plain} ", f"\t\n {plain}\r\n  ", plain + " " * (8192 - len(plain))]
    bad = [plain + " " * (8193 - len(plain)), plain + "\u00a0", plain + " ]", f"{plain}}}", f"{plain},", f"{plain} {plain}", f"[{plain}]", "", "  ", None, "null", '"x"', plain.replace(":64:", ":60:"), plain.replace('"v"', '"V"')]
    bad += ['{"format":"scqr1","views":[]}', '{"format":"scqr1","views":{}}', '{"format":"scqr1","views":null}', '{"format":1,"views":{"v":"x"}}', f'{{"format":"scqr1","views":{{"v":"{stamp}","w":7}}}}']
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad)], "i long, t string")
    told = {r["i"]: r["p"] for r in rows.select("i", payloads.parse_portable(F.col("t")).alias("p")).collect()}
    assert [told[i] for i in range(len(good))] == [{"v": stamp}] * len(good) and not any(told[i] for i in range(len(good), len(told)))
