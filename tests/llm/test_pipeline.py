import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from evidencelake.llm import language, simhash
from evidencelake.llm.queries import tokenizer_path
from pyspark.sql import functions as F
from test_operators import groups_by_edits

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_mix_stage_with_null_and_repeated_ids(spark):
    # weights 5, 2, 1 to three sources of 120 words each: a is taken twice, b and c in part
    rows = [(i if i % 4 else None, " ".join([f"{s}{i}"] * 10), "en", s, i) for s in "abc" for i in range(12)]
    rows += [(7, " ".join(["other"] * n), "en", "b", 0) for n in (10, 10, 3)] + [(7, " ".join(["other"] * 3), None, "c", 0), (None, None, "en", "a", 0)]
    docs = spark.createDataFrame(rows, SCHEMA)
    once, again = (Counter(map(tuple, corpus_pipeline.mix_sources(spark, docs.repartition(n), "").collect())) for n in (1, 5))
    assert once == again and set(once) <= set(rows)
    given, sizes, words = Counter(rows), defaultdict(int), defaultdict(int)
    for row in rows:
        sizes[row[3]] += len((row[1] or "").split())
    for row, n in once.items():
        assert n <= 2 * given[row]
        words[row[3]] += n * len(row[1].split())
    # the first source stops at two passes, the others share the rest by 2 to 1
    rest = 1.5 * sum(sizes.values()) - 2 * sizes["a"]
    assert words["a"] == 2 * sizes["a"] and all(once[r] == 2 * given[r] for r in rows if r[3] == "a" and r[1])
    b = min(rest * 2 / 3, 2 * sizes["b"])
    assert abs(words["b"] - b) <= 1.5 and abs(words["c"] - (rest - b)) <= 5


def small_corpus():
    """Rows with null and repeated ids, copies, near copies, repeated and near lines, and texts without words or letters."""
    rng = random.Random(21)
    stock = {"xx": ["tha", "ing", "ove", "ith", "and"], "yy": ["sch", "ung", "eit", "ich", "der"]}
    word = lambda lang: "".join(rng.choice(stock[lang]) for _ in range(rng.randint(1, 3)))
    line = lambda lang: " ".join(word(lang) for _ in range(rng.randint(6, 25))).capitalize() + "."
    common = {lang: line(lang) for lang in stock}
    rows = []
    for i in range(40):
        lang = "xx" if i % 2 else "yy"
        body = [line(lang) for _ in range(rng.randint(1, 4))]
        if i % 3 == 0:
            words = common[lang].split()
            words[rng.randrange(len(words))] = "changed"
            body.insert(rng.randrange(len(body) + 1), " ".join(words) if i % 2 else common[lang])
        rows.append((i, "\n".join(body), lang if i % 5 else None, f"s{i % 3}", 0))
    rows += [(50, rows[4][1], "yy", "s1", 0), (50, rows[4][1], "yy", "s1", 0), (None, rows[7][1] + "\nOne more line stands here.", "xx", "s0", 0), (51, "12 34 !!", "xx", "s0", 0)]
    rows += [(52, None, "xx", "s0", 0), (53, "", "yy", "s0", 0), (54, line("xx"), "xx", None, 0), (54, line("yy"), "yy", None, 0)]
    return [(i, t, lang, src, len(t or "")) for i, t, lang, src, _ in rows]


def by_letters(rows):
    """Documents with a letter, a null language guessed from prototypes that plain loops bundle."""
    import zlib

    vectors, sums = language.TripleVectors(), {}
    learns = [(t, lang) for i, t, lang, *_ in rows if lang and t is not None and (i is None or zlib.crc32(str(i).encode()) % 4 != 2)]
    for text, lang in learns:
        keys, counts = language.triples(text)
        if len(keys):
            sums[lang] = sums.get(lang, 0) + vectors.bundle(keys, counts * language.UNITS // counts.sum())
    out = []
    for row in rows:
        keys, counts = language.triples(row[1])
        if len(keys):
            v = vectors.bundle(keys, counts)
            guess = max(sorted(sums), key=lambda n: sums[n] @ v / np.linalg.norm(sums[n]))
            out.append((*row[:2], row[2] or guess, *row[3:]))
    return out


def without_repeats(rows):
    """Lines that equal or resemble an earlier one taken out: all pairs by edits."""
    norm = lambda x: re.sub(r"[^\w]+", " ", x.lower().replace("_", " ")).strip().split()
    docs = sorted({(r[0] is not None, r[0] or 0, r[1]) for r in rows if r[1] is not None}, key=lambda d: d[:2])
    places = [(d, n, norm(x)) for d in docs for n, x in enumerate(d[2].split("\n")) if norm(x)]
    distinct = list(dict.fromkeys(tuple(p[2]) for p in places))
    root = dict(zip(distinct, groups_by_edits(distinct)))
    kept, gone = set(), defaultdict(set)
    for d, n, words in places:
        if root[tuple(words)] in kept:
            gone[d].add(n)
        kept.add(root[tuple(words)])
    out = []
    for r in rows:
        drop = gone[(r[0] is not None, r[0] or 0, r[1])]
        text = r[1] if not drop else "\n".join(x for n, x in enumerate(r[1].split("\n")) if n not in drop)
        if not drop or re.search(r"[^\W_]", text):
            out.append((r[0], text, r[2], r[3], len(text)))
    return out


def one_of_each(rows):
    """The smallest id of each group of fingerprints within two bits, one row of it by text."""
    prints = [simhash.fingerprint_of(r[1]) for r in rows]
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    groups = defaultdict(list)
    for r, g in zip(rows, root):
        groups[g].append(r)
    return [min(x[0] if x[0] is not None else 1 << 62 for x in g) for g in groups.values()]


def test_each_stage_and_run_equal_plain_loops(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = small_corpus()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("extra", F.lit(1))
    letters = spark.createDataFrame(corpus_pipeline.language_id(spark, docs, "").collect(), SCHEMA)
    assert Counter(map(tuple, letters.collect())) == Counter(by_letters(rows))
    cleaned = spark.createDataFrame(corpus_pipeline.line_dedup(spark, letters, "").collect(), SCHEMA)
    assert Counter(map(tuple, cleaned.collect())) == Counter(without_repeats(by_letters(rows)))
    single = spark.createDataFrame(corpus_pipeline.simhash_dedup(spark, cleaned, "").collect(), SCHEMA)
    stay = [tuple(r) for r in single.collect()]
    assert set(stay) <= {tuple(r) for r in cleaned.collect()}
    assert sorted(r[0] if r[0] is not None else 1 << 62 for r in stay) == sorted(one_of_each([tuple(r) for r in cleaned.collect()]))
    mixed = [tuple(r) for r in corpus_pipeline.mix_sources(spark, single, "").collect()]
    given = Counter(stay)
    assert set(mixed) <= set(stay) and all(n <= 2 * given[r] for r, n in Counter(mixed).items())
    known = Tokenizer.from_file(tokenizer_path())
    want = Counter((i, lang, src, tuple(known.encode(t or "", add_special_tokens=False).ids)) for i, t, lang, src, _ in mixed)
    docs.drop("extra").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["lang"], r["source"], tuple(r["ids"])) for r in got) == want
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in got)


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    for _, step in corpus_pipeline.STAGES:
        assert step(spark, docs, "").count() == 0
