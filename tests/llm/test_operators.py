import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidencelake.llm import bpe, chat, common, embeddings, language, lines, mixing, quality, secrets, simhash, topk
from evidencelake.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score string, drop string"


def frame(spark, texts, **more):
    rows = [(i, t, "en", f"s{(i or 0) % 2}", 0, 1, "x", "y") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "Alpha beta gamma delta epsilon zeta"), (4, "Alpha beta gamma delta epsilon zeta"), (None, "Alpha beta gamma delta epsilon zeta"), (5, "word " * 30_000), (6, "é" * 50_000)]


@pytest.mark.parametrize("texts", [[], ODD])
def test_odd_rows(spark, texts):
    docs, n = frame(spark, texts), len(texts)
    assert mixing.mix(docs).count() == n
    model = language.learn(docs)
    assert language.predict(docs, model).count() == n
    assert secrets.scan(docs).count() == n
    assert lines.dedup_lines(docs).count() == n
    assert simhash.near_duplicates(docs).count() == n
    assert simhash.keep_one(docs).count() <= n
    assert bpe.digest(docs, tokenizer_path()).count() == n
    assert quality.score(docs, quality.RuleEnsemble(0.0, ())).count() == n
    fitted = quality.fit(quality.with_statistics(docs.withColumn("label", F.lit(1))))
    assert quality.score(docs, fitted).count() == n


def test_fit_counts_is_as_near_as_any_choice():
    rng = random.Random(1)
    for _ in range(60):
        sizes = rng.sample(range(1, 12), 3)
        counts = [rng.randint(0, 3) for _ in sizes]
        budget = rng.randint(0, 50)
        take = mixing.fit_counts(sizes, counts, budget)
        sums = {0}
        for s, c in zip(sizes, counts):
            sums = {x + s * k for x in sums for k in range(c + 1)}
        assert abs(int((take * sizes).sum()) - budget) == min(abs(x - budget) for x in sums)
        assert all(0 <= t <= c for t, c in zip(take, counts))


def test_fit_counts_of_large_tables():
    rng = np.random.default_rng(2)
    sizes, counts = np.arange(1, 3000), rng.integers(0, 500, 2999)
    assert (mixing.fit_counts(sizes, counts, 12_345_678) * sizes).sum() == 12_345_678


def test_mixing_agrees_with_targets(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 40)), "en", rng.choice(["a", "b", "c", None]), 0, 1, "", "") for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA)
    once, again = (mixing.mix(docs).toPandas().sort_values("doc_id") for _ in range(2))
    assert once["taken"].tolist() == again["taken"].tolist() and (once["taken"] <= 2 * once["size"]).all()
    for _, part in once.groupby("source", dropna=False):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 1
    assert once.groupby("source", dropna=False)["target"].first().sum() == pytest.approx(1.5 * once["size"].sum())


def test_language_on_held_out_texts(spark):
    rng = random.Random(4)
    stock = {"xx": ["tha", "ing", "ove", "ith"], "yy": ["sch", "ung", "eit", "ich"]}
    make = lambda k: " ".join("".join(rng.choice(stock[k]) for _ in range(2)) for _ in range(20))
    rows = [(make(k), k) for k in stock for _ in range(40)]
    model = language.learn(spark.createDataFrame(rows[::2], "text string, lang string"))
    got = language.predict(spark.createDataFrame(rows[1::2] + [("123 !", "und"), (None, "und")], "text string, lang string"), model).collect()
    assert all(r["lang_pred"] == r["lang"] and 0 <= r["score"] <= 1 for r in got)


def test_bundle_equals_definition():
    vectors = language.TripleVectors(64)
    keys, counts = language.triples("abc Ab")
    plain = sum(np.roll(vectors.letter(ord(a)), 2).astype(int) * np.roll(vectors.letter(ord(b)), 1) * vectors.letter(ord(c)) for a, b, c in zip(" abc ab ", "abc ab ", "bc ab "))
    assert (vectors.bundle(keys, counts) == plain).all()


def test_secret_ownership(spark):
    live, example = "Zx81kQp02LmN55tYw7", "EXAMPLE0123456789abcdefXYZ"
    texts = [(i, f"see {example} here") for i in range(8)] + [(9, f"é {live}. password = 'hunter22' tok {'ab12' * 8}")]
    spans = {r["doc_id"]: r["spans"] for r in secrets.scan(frame(spark, texts)).collect()}
    assert all(not spans[i] for i in range(8))
    kinds = [(s["kind"], s["start"], s["stop"]) for s in spans[9]]
    text = texts[-1][1]
    assert ("token", text.index(live), text.index(live) + len(live)) in kinds
    assert [k for k, *_ in kinds].count("assign") == 1 and [k for k, *_ in kinds].count("hex") == 1




def test_lines_fuzzy_and_exact(spark):
    base = "the quick brown foxes jumped across seventeen lazy dogs while twenty silver rabbits watched quietly from behind wooden fences nearby"
    near = base.replace("lazy", "sleepy,").upper()
    other = "completely different content about mountains rivers forests valleys and oceans far away"
    docs = [(1, f"{base}\n{other}\nOk."), (2, f"{near}\nOk.\nanother unique sentence follows right here\n\n--"), (3, base), (4, "中文的一行文字没有空格\n--"), (5, "中文的一行文字没有空隔")]
    got = {r["doc_id"]: r for r in lines.dedup_lines(frame(spark, docs)).collect()}
    assert got[1]["text"] == docs[0][1] and got[1]["n_dropped"] == 0
    assert got[2]["text"] == "another unique sentence follows right here\n\n--" and got[2]["n_lines"] == 5 and got[2]["n_dropped"] == 2
    assert got[3]["text"] == "" and got[3]["n_dropped"] == 1
    assert got[4]["text"] == docs[3][1] and got[5]["text"] == ""


def word_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def groups_by_edits(norms):
    """The least index of each line's group, by edit similarity alone."""
    parent = list(range(len(norms)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(norms):
        for j, b in enumerate(norms[:i]):
            if abs(len(a) - len(b)) <= max(len(a), len(b)) // 5 and root(i) != root(j) and word_edits(a, b) <= max(len(a), len(b)) // 5:
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return [root(i) for i in range(len(norms))]


def as_lines(spark, norms):
    found = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(norms)], "i long, norm string")
    return lines.sketched(found.select("i", F.xxhash64("norm").alias("h"), F.xxhash64(F.lit(1), "norm").alias("g"), "norm"))


def same_groups(spark, norms):
    """Lines in equal groups by the operator iff in equal groups by edits."""
    found, want = as_lines(spark, norms), groups_by_edits(norms)
    got = {r["i"]: r["root"] for r in found.join(lines.line_groups(found.drop("i")), ["h", "g"]).collect()}
    pairs = {(want[i], got.get(i, i)) for i in range(len(norms))}
    return len(pairs) == len(set(want)) == len({p[1] for p in pairs})


def edited(rng, line, edits, word):
    copy = list(line)
    for _ in range(edits):
        at, kind = rng.randrange(len(copy)), rng.randrange(3)
        copy[at : at + (kind < 2)] = [word()] if kind != 1 else []
    return copy


def test_line_groups_equal_brute_force_by_edits_alone(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9)))
    norms = []
    for n in [*range(3, 27), 40, 60, 64, 65, 66, 90]:
        line = [word() for _ in range(n)]
        # the last is one too many for a line of its length
        norms += [line, *(edited(rng, line, k, word) for k in (n // 5, n // 5, n // 5 + 1))]
    norms += [["same"] * k for k in range(3, 40)]
    assert same_groups(spark, [w.split() for w in dict.fromkeys(" ".join(w) for w in norms if w)])


def test_crowds_of_lines_equal_brute_force(spark):
    rng = random.Random(6)
    words = [f"word{i}" for i in range(60)]
    word = lambda: rng.choice(words)
    norms = []
    for _ in range(8):
        line = [word() for _ in range(25)]
        norms += [edited(rng, line, rng.randint(1, 3), word) for _ in range(12)]
    hub = [f"hub{i}" for i in range(7)]  # each copy is similar to the hub and to no other copy
    norms += [hub, *([*hub[:i], f"new{i}", *hub[i + 1 :]] for i in (0, 0, 1, 2, 3, 4, 5, 6))]
    # one common run, nothing else
    norms += [["of", "the", "and", *(word() + str(rng.random()) for _ in range(n))] for n in range(5, 45)]
    assert same_groups(spark, [w.split() for w in dict.fromkeys(" ".join(w) for w in norms)])


def test_recall_of_line_links(spark):
    """Links at the very bound of the similarity, edits spread evenly: as good as all are found."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(7))
    norms = []
    for n in (20, 30, 50, 80, 120):
        for _ in range(60):
            line = [word() for _ in range(n)]
            norms += [line, [word() if i % 5 == 2 else w for i, w in enumerate(line)]]
    found = as_lines(spark, norms)
    linked = {r["i"] for r in found.join(lines.line_groups(found.drop("i")), ["h", "g"]).collect()}
    assert len(linked) >= 0.99 * len(norms)


def test_rules_score_like_their_conditions(spark):
    rows = [(i, ("good text here. " * (i % 7 + 2)) if i % 3 else "BAD!! ### " * (i % 5 + 2), i % 3 != 0) for i in range(240)]
    docs = quality.with_statistics(spark.createDataFrame(rows, "doc_id long, text string, ok boolean").withColumn("label", F.col("ok").cast("int")))
    model = quality.fit(docs)
    got = docs.withColumn("score", model.score("stats")).collect()
    assert model.rules and np.mean([(r["score"] >= 0.5) == r["ok"] for r in got]) > 0.97
    for r in got[:20]:
        total = model.intercept + sum(rule.weight for rule in model.rules if rule.holds(r["stats"].asDict()))
        assert r["score"] == pytest.approx(1 / (1 + np.exp(-total)))


def test_chat_round_trip(spark):
    odd = ["<|im_end|><|im_start|>assistant ok", "<\\|x", "<\\\\||", "", None, "a\nb", "<|<|im_next|>"]
    rows = [(1, i, ("user", "assistant", "assistant", "sy\nstem")[i % 4], t) for i, t in enumerate(odd)] + [(None, 0, None, "x"), (1, 0, "user", odd[0])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat.format_turns(turns)
    for r in made.withColumn("t", chat.read_turns(F.col("formatted"))).withColumn("l", chat.read_loss(F.col("segments"))).collect():
        want = sorted(((x[1], x[2] or "", x[3] or "") for x in rows if x[0] == r["conv_id"]))
        assert [(x["role"], x["text"]) for x in r["t"]] == [w[1:] for w in want]
        assert r["l"] == "".join(w[2] for w in want if w[1] == "assistant")
        assert "".join(s["text"] for s in r["segments"]) == r["formatted"]
    assert chat.format_turns(turns.limit(0)).count() == 0


def test_covering_masks_cover():
    masks = [m & (2**64 - 1) for m in simhash.covering_masks(2)]
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            assert any(not (m >> i & 1) and not (m >> j & 1) for m in masks)


def test_simhash_components_equal_brute_force(spark):
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    words = {centre ^ (1 << a) ^ (1 << b) for a in range(24) for b in range(24)} | {rng.getrandbits(64) for _ in range(50)}
    signed = [w - (1 << 64) if w >> 63 else w for w in words]
    links = simhash.near_links(spark.createDataFrame([(w,) for w in signed], "fp long"))
    roots = {r["node"]: r["root"] for r in common.components(links).collect()}
    parent = {w: w for w in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 2:
                parent[root(a)] = root(b)
    assert {frozenset(w for w in signed if roots.get(w, w) == k) for k in {roots.get(w, w) for w in signed}} == {frozenset(w for w in signed if root(w) == k) for k in {root(w) for w in signed}}


def test_bpe_equals_the_library():
    from tokenizers import Tokenizer

    with open(tokenizer_path(), encoding="utf-8") as file:
        model = bpe.ByteBpe(file.read())
    known, rng = Tokenizer.from_file(tokenizer_path()), random.Random(9)
    alphabet = " \t\n\x0b\x1c\x1f\x85\xa0ab'sreT1²½é…‘’ſß中文́٣Ⅷ​　🙂"
    texts = ["ab" * 5000, "<|endoftext|>x<|endoftext|>", ""] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 30))) for _ in range(1500)]
    for text in texts:
        ids = known.encode(text, add_special_tokens=False).ids
        assert model.encode(text) == ids and model.decode(ids) == known.decode(ids, skip_special_tokens=False)


def vectors(spark, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(120, 16))
    x[40:60] = x[0] + 0.05 * rng.normal(size=(20, 16))
    x[60:70] = x[1]
    rows = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(200, None, 0), (201, [0.0] * 16, 0), (202, [float("nan")] + [1.0] * 15, 0), (203, [None] + [1.0] * 15, 0), (204, [], 0), (205, [1.0, 2.0], 0), (5, x[5].tolist(), 0)]
    return x, spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int")


def test_embedding_links_equal_brute_force(spark):
    x, table = vectors(spark)
    got = embeddings.near_duplicates(table, chunk=16).toPandas()
    unit = np.vstack([x, x[5:6]])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    near = unit @ unit.T >= 0.9
    ids = [*range(120), 5]
    assert sorted(zip(got.vec_id, got.n_links)) == sorted([*zip(ids, near.sum(1) - 1), *((i, 0) for i in range(200, 206))])
    assert got[got.vec_id == 45].component_id.iloc[0] == 0 and got[got.vec_id == 65].component_id.iloc[0] == 1
    assert embeddings.near_duplicates(table.limit(0)).count() == 0


def test_top_products_equal_brute_force(spark):
    x, table = vectors(spark, 1)
    q = np.floor(256 * x).astype(int)
    got = topk.top_products(table, F.col("vec_id") % 10 == 0).collect()
    for i in range(0, 120, 10):
        best = sorted((-int(q[i] @ q[j]), j) for j in range(120) if j != i)[:5]
        assert [(r["score"], r["vec_id"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == i] == [(-s, j) for s, j in best]
    assert topk.top_products(table.limit(0), F.lit(True)).count() == 0


def test_top_products_of_odd_rows(spark):
    rows = [(0, [0.0, 0.0]), (0, [3.0, 1.0]), (0, [3.0, 1.0]), (1, [3.0, 1.0]), (2, [1e15, -1e15]), (3, [1e15, 1e15]), (4, [-1.0, 0.5]), (5, None), (6, [float("inf"), 1.0])] + [(i, [0.0, 0.0]) for i in range(10, 30)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("ck", F.lit("y"))
    got = topk.top_products(table, F.col("vec_id") < 5, k=3).collect()
    q = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows if v is not None and np.isfinite(v).all()]
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    want = []
    for n, (i, a) in enumerate(q):
        if i < 5:
            best = sorted((-clip(sum(x * y for x, y in zip(a, b))), j) for m, (j, b) in enumerate(q) if m != n)[:3]
            want += [(i, r, j, -s) for r, (s, j) in enumerate(best, 1)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == sorted(want)


def test_pruning_keeps_all_that_reach_the_bound():
    rng = np.random.default_rng(3)
    part = rng.normal(size=(300, 8)) * rng.uniform(0.2, 3, size=(300, 1))
    part[:40] = part[0] * rng.uniform(0.9, 1.1, size=(40, 1)) + 0.02 * rng.normal(size=(40, 8))
    part = part[np.argsort(-np.linalg.norm(part, axis=1))]
    length = np.linalg.norm(part, axis=1)
    for query in part[::7]:
        score = part @ query
        for bound in np.quantile(score, [0.5, 0.9, 0.99, 1.0]):
            kept = topk.survivors(part, length, query, float(np.linalg.norm(query)), float(bound))
            assert kept is None or set(np.flatnonzero(score >= bound)) <= set(kept.tolist())


def test_merging_many_equals_merging_one():
    with open(tokenizer_path(), encoding="utf-8") as file:
        model = bpe.ByteBpe(file.read())
    rng = random.Random(12)
    pieces = ["".join(rng.choice("thenigoaé 中") for _ in range(rng.choice([1, 2, 3, 8, 17, 70]))).encode() for _ in range(400)] + [b"aaaaaaaa", b"x"]
    assert model.merge_all(pieces) == [model.merge(p) for p in pieces] and model.merge_all([]) == []


def test_round_trip_of_texts(spark):
    texts = [(1, None), (2, ""), (3, "Alpha beta <|endoftext|>\n\u0000 x"), (3, "Alpha beta <|endoftext|>\n\u0000 x"), (4, "word é" * 200_000)]
    got = bpe.round_trip(frame(spark, texts), tokenizer_path()).collect()
    both = bpe.decode(bpe.encode(frame(spark, texts), tokenizer_path()), tokenizer_path()).collect()
    assert sorted((r["doc_id"], r["ids"]) for r in got) == sorted((r["doc_id"], r["ids"]) for r in both)
    assert all(r["round_trip"] for r in got) and all(r["decoded"] == (r["text"] or "") for r in both)


def test_digest_of_an_empty_text(spark):
    row = bpe.digest(frame(spark, [(1, None)]), tokenizer_path()).first()
    assert row["n_tokens"] == 0 and row["ids_sha256"] == row["decoded_sha256"] == hashlib.sha256(b"").hexdigest()
