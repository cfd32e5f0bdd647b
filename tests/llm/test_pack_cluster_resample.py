"""Packing, clustering and resampling against plain loops."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from evidencelake.llm import centroids, packing, queries, resample
from pyspark.sql import functions as F
from tokenizers import Tokenizer

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "Alpha beta gamma"), (4, "Alpha beta gamma"), (None, "Alpha beta"), (5, "word " * 30_000), (6, "é" * 50_000), (None, None)]


def documents(spark, rows):
    """Extra columns have names that the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in rows], "doc_id long, text string, open string, score int, row int")


def written(spark, path, **tables):
    for name, frame in tables.items():
        frame.write.parquet(f"{path}/{name}.parquet")
    return str(path)


# packing


def test_ids_equal_the_library():
    with open(queries.tokenizer_path(), encoding="utf-8") as file:
        source = file.read()
    known, rng = Tokenizer.from_file(queries.tokenizer_path()), random.Random(9)
    alphabet = " \t\n\x0b\x1c\x1f\x85\xa0ab'sreT1²½é…‘’ſß中文́٣Ⅷ​　🙂"
    texts = ["ab" * 5000, "<|endoftext|>x<|endoftext|>", "", " \t" * 20_000 + "x", "word it's " * 50_000] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    for text in texts:
        assert packing.encoded(source, text).tolist() == known.encode(text, add_special_tokens=False).ids


def most_packed(sizes, capacity):
    """The least number of bins, by trying all."""
    best = len(sizes)

    def go(at, fills):
        nonlocal best
        if len(fills) >= best:
            return
        if at == len(sizes):
            best = len(fills)
            return
        for i in range(len(fills)):
            if fills[i] + sizes[at] <= capacity:
                fills[i] += sizes[at]
                go(at + 1, fills)
                fills[i] -= sizes[at]
        go(at + 1, [*fills, sizes[at]])

    go(0, [])
    return best


def test_bound_and_search_on_small_sets():
    rng, over = random.Random(1), 0
    for _ in range(150):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        size, least = np.array(sizes), most_packed(sizes, 20)
        bins = packing.settled(size, None, 20)
        assert packing.least_bins(size, 20) <= least <= len(set(bins.tolist()))
        assert np.bincount(bins, size).max() <= 20
        over += len(set(bins.tolist())) - least
    assert over <= 2


def test_search_empties_bins_that_best_fit_leaves():
    size = np.random.default_rng(1).integers(600, 760, 2000)
    start = packing.best_fit(size, 2048)
    found = packing.searched(size, start, 2048)
    assert len(np.unique(found)) < 0.97 * len(np.unique(start)) and np.bincount(found, size).max() <= 2048


@pytest.mark.parametrize("given, wanted", [([12, 5], [8, 5, 5]), ([7, 4, 9], [10, 10]), ([9, 1], [5, 3])])
def test_each_exchange_raises_squared_fills(given, wanted):
    """One for one, two for one, one for two: the bin of ``given`` gives tokens away."""
    size, bins = np.array([*given, *wanted]), np.array([0] * len(given) + [1] * len(wanted))
    state = packing.Exchange(size, bins, 24)
    before = state.fill.copy()
    assert state.step(0)
    assert (state.fill**2).sum() > (before**2).sum() and state.fill[0] < before[0] and (np.bincount(state.bins, size) == state.fill).all()


def check_packed(rows, docs, capacity):
    known = Tokenizer.from_file(queries.tokenizer_path())
    want = Counter()
    for i, text in docs:
        ids = [*known.encode(text or "", add_special_tokens=False).ids, 0]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[(i, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter(tuple(r[:5]) for r in rows) == want
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        ends = [0, *itertools.accumulate(n for _, n in sorted(parts))]
        assert [at for at, _ in sorted(parts)] == ends[:-1] and ends[-1] <= capacity
    return len(sequences)


def test_op11_pieces_and_sequences(spark, tmp_path):
    rng = random.Random(2)
    docs = ODD + [(i, " ".join(rng.choice(["one", "twelve", "Xq"]) for _ in range(rng.choice([3, 50, 400, 3000])))) for i in range(10, 300)]
    path = written(spark, tmp_path, documents=documents(spark, docs).repartition(5))
    rows = queries.op11_pack_sequences(spark, path).collect()
    n = check_packed(rows, docs, 2048)
    assert n <= 1.02 * packing.least_bins(np.array([r["length"] for r in rows]), 2048) + 2


def test_shards_meet_in_rounds(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(["one"] * rng.randint(0, 60))) for i in range(900)]
    rows = packing.pack(documents(spark, docs).repartition(6), queries.tokenizer_path(), capacity=64, shard=40).collect()
    assert check_packed(rows, docs, 64) <= 1.05 * packing.least_bins(np.array([r["length"] for r in rows]), 64) + 1
    assert packing.pack(documents(spark, []), queries.tokenizer_path()).count() == 0


# clustering


def plain_clusters(rows, k=8, rounds=10):
    """rows: (vec_id, vector).  [(vec_id, cluster, distance)], centroids."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    named = sorted(kept, key=lambda r: (hashlib.sha256(f"3:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centres = [q for _, q in named[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda q: min((far(q, c), j) for j, c in enumerate(centres))
    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(near(q)[1], []).append(q)
        centres = [[sum(x) // len(groups[j]) for x in zip(*groups[j])] if j in groups else c for j, c in enumerate(centres)]
    return [(i, *near(q)[::-1]) for i, q in kept], centres


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<double>, cluster int, apex int")


def clustered(n, spread, seed):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, 64))
    return [(i, (middles[i % 6] + spread * rng.normal(size=64)).tolist()) for i in range(n)]


@pytest.mark.parametrize("spread", [0.05, 1.5])
def test_op12_clusters(spark, tmp_path, spread):
    rows = clustered(160, spread, 4)
    rows += [(7, rows[7][1]), (None, rows[3][1]), (900, None), (901, [0.5] * 63), (902, [float("nan")] * 64), (903, [None] * 64), (904, [0.0] * 64), (905, []), (906, [float("inf")] * 64)]
    got = queries.op12_cluster_centroids(spark, written(spark, tmp_path, embeddings=vectors(spark, rows).repartition(3))).collect()
    want, centres = plain_clusters(rows)
    assert Counter((r["vec_id"], r["cluster"], r["distance"]) for r in got) == Counter(want)
    inertia = Counter()
    for _, c, d in want:
        inertia[c] += d
    for r in got:
        assert r["cluster_inertia"] == inertia[r["cluster"]] and r["inertia"] == sum(inertia.values())
        assert r["centroid_sha256"] == hashlib.sha256(",".join(map(str, centres[r["cluster"]])).encode()).hexdigest()


def test_few_equal_and_huge_vectors(spark):
    assert centroids.cluster(vectors(spark, [])).count() == 0
    rows = [(i, [0.25] * 64) for i in range(20)] + [(30, [1e300] * 64), (31, [-1e300] + [0.0] * 63)]
    got = {r["vec_id"]: r for r in centroids.cluster(vectors(spark, rows), k=3).collect()}
    assert len(got) == 22 and len({got[i]["cluster"] for i in range(20)}) == 1 and all(r["distance"] >= 0 for r in got.values())
    assert [r["cluster"] for r in centroids.cluster(vectors(spark, rows[:2])).collect()] == [0, 0]


def test_bounds_hold_and_filter():
    q = np.array([[math.floor(1024 * x) for x in v] for _, v in clustered(400, 0.3, 5)])
    simplex = centroids.Simplex.over(np.vstack([q[:8], q[:1]]))
    assert len(simplex.pivots) == 8  # the repeated one lies in the base
    a, true = simplex.apexes(q), np.sqrt(np.array([centroids.squares(q, p) for p in q[50:90]]).T)
    b = a[50:90]
    base = ((a[:, None, :-1] - b[None, :, :-1]) ** 2).sum(axis=2)
    assert (np.sqrt(base + (a[:, None, -1] - b[None, :, -1]) ** 2) <= true + 1e-6).all()
    assert (np.sqrt(base + (a[:, None, -1] + b[None, :, -1]) ** 2) >= true - 1e-6).all()
    centres = np.array([q[i::6].sum(axis=0) // len(q[i::6]) for i in range(6)])
    found, compared = centroids.nearest(q, a, centres, simplex.apexes(centres))
    assert (found == np.array([centroids.squares(q, c) for c in centres]).argmin(axis=0)).all() and compared < 0.2 * len(q) * 6


# resampling

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain_resample(docs, target):
    def parts(text):
        w = WORDS.findall((text or "").translate(LOWER))
        return len(w), [zlib.crc32(f.encode()) % 10000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]

    made = [parts(t) for _, t in docs]
    s, t = Counter(b for _, f in made for b in f), Counter(b for x in target for b in parts(x)[1])
    size, wanted = sum(s.values()) + 10000, sum(t.values()) + 10000
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * float(size) / ((s[b] + 1) * float(wanted))))
    rows = []
    for (i, _), (n, f) in zip(docs, made):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([n, i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((r for r in rows if r[0] >= 20), key=lambda r: (-r[4], -math.inf if r[1] is None else r[1]))
    drawn = {id(r): n for n, r in enumerate(order[: 25 * len(order) // 100], 1)}
    return [(*r[1:], drawn.get(id(r))) for r in rows]


def benchmark(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")


def test_op13_draws(spark, tmp_path):
    rng = random.Random(6)
    stock = [f"w{i}" for i in range(200)] + ["Ünï", "A-B", "x_y", "中文", "ß9"]
    docs = ODD[:7] + [(i, " ".join(rng.choice(stock[: 40 if i % 3 else 205]) for _ in range(rng.choice([0, 1, 19, 20, 60])))) for i in range(10, 700)]
    target = [" ".join(rng.choice(stock[:40]) for _ in range(50)) for _ in range(9)] + [None, ""]
    path = written(spark, tmp_path, documents=documents(spark, docs).repartition(5), benchmark=benchmark(spark, target))
    got = queries.op13_target_resample(spark, path).collect()
    assert Counter(map(tuple, got)) == Counter(plain_resample(docs, target))
    assert queries.op13_target_resample(spark, path).schema.simpleString() == "struct<doc_id:bigint,n_features:bigint,weight:bigint,score:bigint,rank:bigint>"


def test_draws_of_few_equal_and_no_rows(spark):
    none = benchmark(spark, [])
    assert resample.resample(documents(spark, []), none).count() == 0
    docs = [(1, "a " * 25)] * 30 + [(None, "b " * 25)] * 30
    got = resample.resample(documents(spark, docs), none).collect()
    assert Counter(r["rank"] for r in got if r["rank"]) == Counter(range(1, 16)) and len(got) == 60
    assert all(r["rank"] is None for r in resample.resample(documents(spark, docs[:3]), none).collect())


def test_bracket_holds_the_cutoff(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000).cast("long").alias("score"))
    scores = sorted((r["score"] for r in rows.collect()), reverse=True)
    for taken in (1, 1250, 3300, 4990, 5000):
        low, high, above = resample.bracket(rows, "score", 5000, taken)
        assert low <= scores[taken - 1] <= high and above == sum(s > high for s in scores)
