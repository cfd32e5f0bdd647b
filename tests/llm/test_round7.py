import numpy as np
from pyspark.sql import functions as F

from evidencelake.llm import embeddings


def test_embedding_rounds_send_what_the_table_holds(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 16)).astype(np.float32).astype(float)
    x[100:220] = (x[0] + 0.02 * rng.normal(size=(120, 16))).astype(np.float32)
    rows = [(f"v{i:03}", v.tolist()) for i, v in enumerate(x)] + [("w", x[7].tolist()), ("x", [1.0, 2.0]), ("y", [2.0, 4.0]), ("z", None)]
    table = spark.createDataFrame(rows, "vec_id string, embedding array<float>")
    for name, value in {"GROUP": 4096, "ROUND": 1 << 17, "LINKS": 0}.items():
        monkeypatch.setattr(embeddings, name, value)
    class_type, sent = type(table), []
    real = class_type.repartitionById
    monkeypatch.setattr(class_type, "repartitionById", lambda self, *a: sent.append(self.groupBy("task").agg(F.sum(F.octet_length("data")).alias("bytes")).collect()) or real(self, *a))
    got = embeddings.near_duplicates(table).toPandas()
    # a task gets two groups at most, and a round as much as the table or ROUND
    assert len(sent) > 1 and max(t["bytes"] for tasks in sent for t in tasks) <= 2 * 4096 + 4096
    assert max(sum(t["bytes"] for t in tasks) for tasks in sent) <= 1.5 * (1 << 17)
    unit = np.vstack([x, x[7:8]])
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    ids, near = [*(f"v{i:03}" for i in range(300)), "w"], unit @ unit.T >= 0.9
    assert sorted(zip(got.vec_id, got.n_links)) == sorted([*zip(ids, near.sum(1) - 1), ("x", 1), ("y", 1), ("z", 0)])
    least = {r.vec_id: r.component_id for r in got.itertuples()}
    assert {least[f"v{i:03}"] for i in range(100, 220)} == {"v000"} and (least["w"], least["y"], least["z"]) == ("v007", "x", "z")


def test_pairs_of_chunks_equal_brute_force():
    rng = np.random.default_rng(6)
    for dim, rows in ((64, 300), (5, 200), (1, 9), (16, 1)):
        a = rng.normal(size=(rows, dim)) * rng.choice([1e-150, 1.0, 1e150], size=(rows, 1))
        b = np.vstack([a[: rows // 2] * 3 + 0.3 * np.abs(a[: rows // 2]) * rng.normal(size=(rows // 2, dim)), rng.normal(size=(77, dim))])
        for x, y, same in ((a, b, False), (a, a, True)):
            cosine = embeddings.unit(x) @ embeddings.unit(y).T
            want = np.argwhere((cosine >= 0.9) & ((not same) | (np.arange(len(x))[:, None] < np.arange(len(y)))))
            assert np.array_equal(np.array(embeddings.compare(x, y, same, 0.9)).T, want)
