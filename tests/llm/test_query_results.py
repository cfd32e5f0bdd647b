"""Results of registered queries without SQL on small tables: against brute force, the tokenizers library, or labels that no fit has seen."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from evidencelake.llm import queries
from tokenizers import Tokenizer

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


@pytest.fixture
def write(spark, tmp_path):
    def made(name, rows, schema):
        spark.createDataFrame(rows, schema).repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return made


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def texts(seed, n=150):
    rng = random.Random(seed)
    stock = ["alpha", "Beta", "gamma,", "ÉPÉE", "épée", "x1", "the", "of"] + [f"w{i}" for i in range(200)]
    out = [" ".join(rng.choices(stock, k=rng.randint(0, 60))) for _ in range(n)]
    for _ in range(40):  # near copies: one word of a long text is another
        words = rng.choice([t for t in out if len(t.split()) > 40]).split()
        words[rng.randrange(len(words))] = rng.choice(stock)
        out.append(" ".join(words))
    return [*out, out[3], out[3], None, "", " \t\n", "one two", "word " * 3000, "é" * 20_000]


def groups(n, linked):
    """The least index of each one's group."""
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(n):
        for j in range(i):
            if root(i) != root(j) and linked(i, j):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(n)]


def test_op7_fingerprints_and_components(spark, write):
    docs = texts(1)
    rows = [(i + 7, t) for i, t in enumerate(docs)]
    prints = []
    for t in docs:
        words = WORD.findall((t or "").translate(LOWER))
        runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    want = groups(len(docs), lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    got = {r["doc_id"]: r for r in queries.op7_simhash_dedup(spark, write("documents", rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows) and len(set(want)) < len(rows)
    for i in range(len(docs)):
        assert (got[i + 7]["fingerprint"], got[i + 7]["component_id"]) == (f"{prints[i]:016x}", want[i] + 7)


def test_op8_digests(spark, write):
    known = Tokenizer.from_file(queries.tokenizer_path())
    docs = texts(2) + ["<|endoftext|> in a text", "it's\r\n\x00 2½ 中文 🙂"]
    rows = list(enumerate(docs)) + [(0, docs[0])]
    want = Counter()
    for i, t in rows:
        ids = known.encode(t or "", add_special_tokens=False).ids
        back = known.decode(ids, skip_special_tokens=False)
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())] += 1
    got = queries.op8_bpe_codes(spark, write("documents", rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in got) == want


def test_op9_links_components_and_kept(spark, write):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(160, 64))
    x[40:70] = x[:1] + 0.25 * rng.normal(size=(30, 64))
    for i in range(71, 90):  # a chain of which only neighbours are near
        x[i] = x[i - 1] + 0.4 * rng.normal(size=64)
    x[100:120] = x[5] * np.arange(1, 21)[:, None]
    odd = [None, [0.0] * 64, [float("nan")] * 64, [None] * 64, [1.0, 2.0]]
    rows = [(i + 3, v.tolist()) for i, v in enumerate(x)] + [(500 + i, v) for i, v in enumerate(odd)]
    path = write("embeddings", [(*r, 0, True) for r in rows], "vec_id long, embedding array<double>, n_links int, kept boolean")
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    roots = groups(len(x), lambda i, j: near[i, j])
    want = {(i + 3, int(near[i].sum()) - 1, roots[i] + 3, roots[i] == i) for i in range(len(x))} | {(500 + i, 0, 500 + i, True) for i in range(len(odd))}
    got = queries.op9_embedding_dedup(spark, path).select("vec_id", "n_links", "component_id", "kept").collect()
    assert len(got) == len(rows) and {tuple(r) for r in got} == want


def test_op1_targets_and_words_taken(spark, write):
    rng = random.Random(4)
    sources = ["b", "B", "é", None, "zz"]
    rows = [(i, " ".join(["w"] * rng.randint(0, 50)), rng.choices(sources, [1, 2, 3, 5, 30])[0]) for i in range(500)] + [(9, None, "b"), (None, "a b", "é"), (None, "a b", "é")]
    got = queries.op1_mix_sources(spark, write("documents", rows, "doc_id long, text string, source string")).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    order = sorted(s for s in sizes if s is not None) + [None]
    weight = {s: (5, 2, 1)[n % 3] for n, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while free:  # what is above its limit stops there, and the rest is shared again
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 2.0 * sizes[s] for s in over}
        left, free = left - sum(target[s] for s in over), free - over
    source = {(i, len(WORD.findall(t or "")), sizes[s]): s for i, t, s in rows}
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        s = source[(r["doc_id"], r["size"], r["source_size"])]
        assert r["target"] == pytest.approx(target[s]) and 0 <= r["taken"] <= 2 * r["size"] and (r["taken"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in order)


def test_op5_scores_of_texts_that_no_fit_has_seen(spark, write):
    rng = random.Random(5)
    words = "the a of reason method result shows that we they found clear evidence while some further work remains".split()
    good = lambda: ". ".join(" ".join(rng.choices(words, k=rng.randint(6, 14))).capitalize() for _ in range(rng.randint(3, 9))) + "."
    bad = lambda: " ".join(rng.choice(["$$$", "BUY!!", "click", "###", "12345", "|", "FREE"]) for _ in range(rng.randint(10, 80)))
    rows = [(i, good() if i % 3 else bad()) for i in range(400)] + [(1000, None), (1001, ""), (1002, "x" * 100_000)]
    path = write("documents", rows, "doc_id long, text string")
    write("labels", [(i, int(i % 3 > 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in queries.op5_quality_rules(spark, path).collect()}
    assert len(got) == len(rows)
    for i, r in got.items():
        assert r["held_out"] == held(i) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    unseen = [i for i in range(400) if held(i)]
    assert len(unseen) > 60 and np.mean([got[i]["predicted"] == int(i % 3 > 0) for i in unseen]) > 0.97
