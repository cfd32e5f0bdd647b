"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine c or more are within squared distance 2 - 2c.  A random rotation spreads that distance over
all coordinates; the rotated vectors are cut into blocks, each with a share of the squared budget in proportion to its
dimensions.  Two vectors within the whole budget are within its share in one block at least.  So each block is
range-joined under its share, and the union of what the blocks find is verified with the exact cosine.

Equal vectors are one class first.  Classes are packed into chunks of at most CHUNK, close ones together, by a median
tree over a bounded sample (which decides the layout only).  A chunk knows its least and greatest value in every
coordinate.  Chunks that can hold a pair are found block by block with an equality join on the cells of the block's
leading coordinate, widened by the block's radius, and a check of the boxes.  In a pair of chunks the blocks' range
joins run vector against vector, tile by tile; each pair of vectors meets in one task only.  A task returns link counts
and a spanning forest, never its pairs, so a crowd of near copies costs no more rows than it has members.

On vectors without structure nearly all chunks meet, and chunks sent to each of their pairs would be a multiple of the
table that grows with it.  So chunks next to each other are a group, a task gets two groups once for all pairs of their
chunks, and tasks run in rounds that send about as much as the table holds, whose shuffle files and links are reduced
before the next.  Disk grows with the table; time is that of the pairs of chunks that meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, cut, discard, stage
from .vectors import class_key, finite

COSINE, BLOCKS, SEED = 0.9, 4, 5
CHUNK, TILE = 2048, 128
#: Bytes of vectors, at most, in a chunk and in a group, and bytes that a round may send however small the table is.
GROUP, ROUND = 4 << 20, 256 << 20
#: Groups to aim at, so that there are tasks enough on few vectors, and rows of links a vector beyond which they are reduced.
GROUPS, LINKS = 12, 2
#: Sampled vectors, at most, that lay out the chunks, and parts that a component's classes are dealt to.
SAMPLE, SALTS = 20_000, 32


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64([seed, dim])).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def block_edges(dim: int, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """The coordinate ranges of the blocks; no more blocks than coordinates."""
    blocks = min(blocks, dim)
    at = [round(dim * i / blocks) for i in range(blocks + 1)]
    return list(zip(at, at[1:]))


def median_tree(sample: np.ndarray, depth: int) -> list[tuple[int, float]]:
    """(coordinate, bound) of the inner nodes of a complete tree in heap order: the widest coordinate at its median."""
    nodes, parts = [], [sample]
    for _ in range(depth):
        below = []
        for part in parts:
            axis = int(np.argmax(part.var(axis=0))) if len(part) else 0
            bound = float(np.median(part[:, axis])) if len(part) else 0.0
            nodes.append((axis, bound))
            below += [part[part[:, axis] <= bound], part[part[:, axis] > bound]]
        parts = below
    return nodes


def leaf_of(rotated: np.ndarray, nodes: list[tuple[int, float]]) -> np.ndarray:
    at = np.zeros(len(rotated), np.int64)
    if nodes:
        axes, bounds = np.array([n[0] for n in nodes]), np.array([n[1] for n in nodes])
        rows = np.arange(len(rotated))
        while at[0] < len(nodes) if len(at) else False:
            at = 2 * at + 1 + (rotated[rows, axes[at]] > bounds[at])
    return at


def unit(stacked: np.ndarray) -> np.ndarray:
    scale = np.abs(stacked).max(axis=1, keepdims=True)
    scaled = stacked / scale
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The least reachable index for each of n nodes with edges i-j."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        fresh = label.copy()
        np.minimum.at(fresh, i, low)
        np.minimum.at(fresh, j, low)
        fresh = fresh[fresh]
        if (fresh == label).all():
            return label
        label = fresh


def compare(a: np.ndarray, b: np.ndarray, same: bool, cosine: float, blocks: int = BLOCKS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i, j) of the rows of a and b with this cosine or more; i < j if a and b are the same rows."""
    dim = a.shape[1]
    turn, edges, budget = rotation(dim), block_edges(dim, blocks), max(0.0, 2 - 2 * cosine)
    ua, ub = unit(a), unit(b)
    ra, rb = (ua @ turn).astype(np.float32), (ub @ turn).astype(np.float32)
    # half of what a block's budget has over a pair's square distance, as one product
    sides = []
    for lo, hi in edges:
        x, y = ra[:, lo:hi], rb[:, lo:hi]
        most = np.float32(budget * (hi - lo) / dim + 1e-4)  # far above float32's error
        halves = [(z * z).sum(axis=1, keepdims=True) / 2 for z in (x, y)]
        sides.append((np.hstack([x, -halves[0], np.ones_like(halves[0])]), np.hstack([y, np.ones_like(halves[1]), most / 2 - halves[1]]).T.copy()))
    out_i, out_j = [], []
    room, hit = np.empty((TILE, len(b)), np.float32), np.empty((TILE, len(b)), bool)
    for top in range(0, len(a), TILE):
        n = min(TILE, len(a) - top)
        near = np.zeros((n, len(b)), bool)
        for x, y in sides:
            np.matmul(x[top : top + n], y, out=room[:n])
            near |= np.greater_equal(room[:n], 0, out=hit[:n])
        i, j = np.divmod(np.flatnonzero(near), len(b))
        i += top
        if same:
            i, j = i[i < j], j[i < j]
        for at in range(0, len(i), 1 << 16):
            p, q = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
            ok = np.einsum("nd,nd->n", ua[p], ub[q]) >= cosine
            out_i.append(p[ok])
            out_j.append(q[ok])
    none = np.empty(0, np.int64)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j])


def near_duplicates(vectors: DataFrame, *, cosine: float = COSINE, vec_id: str = "vec_id", vector: str = "embedding", chunk: int = CHUNK) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors``.

    n_links counts the other rows with cosine ``cosine`` or more, in double precision; component_id is the smallest
    vec_id reachable over links, the row's own included.  Vectors that are null, empty, zero or hold null or
    non-finite components link with nothing, and only vectors of equal length are compared.  Rows that repeat a vec_id
    are rows of their own.  A null vec_id takes part and is no component_id unless alone.  Other columns are not
    looked at.
    """
    if not 0 < cosine <= 1:
        raise ValueError("the cosine must be over 0 and at most 1")
    spark = vectors.sparkSession
    single = vectors.schema[vector].dataType.elementType.typeName() == "float"
    kind = np.dtype(np.float32 if single else np.float64)  # compared in double precision either way
    v = F.col(vector) if single else F.transform(F.col(vector), lambda x: x.cast("double"))
    double = F.transform(F.col("v"), lambda x: x.cast("double"))
    rows = vectors.select(F.col(vec_id).alias("vec_id"), v.alias("v")).withColumn("counts", finite(F.col("v")) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False)))
    rows = rows.withColumn("ck", F.when(F.col("counts"), class_key(double)))
    classes = rows.where("counts").groupBy("ck").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.any_value("v").alias("v"))
    classes = stage(classes.withColumn("dim", F.size("v")), "zstd")
    sizes = {r["dim"]: r["count"] for r in classes.groupBy("dim").count().collect()}  # a row per vector length
    trees, most, together = {}, {}, {}
    for dim, count in sizes.items():
        most[dim] = max(1, min(chunk, GROUP // (dim * kind.itemsize)))
        together[dim] = max(1, min(GROUP // (most[dim] * dim * kind.itemsize), -(-count // (most[dim] * GROUPS))))
        share = min(1.0, SAMPLE / count)
        picked = classes.where((F.col("dim") == dim) & (F.shiftrightunsigned(F.xxhash64("ck"), 1) <= F.lit(min((1 << 63) - 1, int(share * (1 << 63)))))).select("v").limit(2 * SAMPLE).collect()
        depth = max(0, int(np.ceil(np.log2(count / most[dim])))) if count > most[dim] else 0
        sample = unit(np.array([r["v"] for r in picked], np.float64).reshape(-1, dim)) @ rotation(dim)
        trees[dim] = median_tree(sample, min(depth, 12))

    def leaves(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(places, leaves, vectors) of a batch's rows, by vector length."""
        dims, values = batch.column("dim").to_numpy(), batch.column("v")
        for dim in np.unique(dims).tolist():
            at = np.flatnonzero(dims == dim)
            stacked = values.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            yield at, leaf_of(unit(stacked.astype(np.float64)) @ rotation(dim), trees[dim]), stacked

    def lay_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(dim, leaf, ...) of classes; with their ids, the vector as bytes."""
        for batch in batches:
            leaf, data = np.zeros(batch.num_rows, np.int64), [b""] * batch.num_rows
            whole = "ck" in batch.schema.names
            for at, found, stacked in leaves(batch):
                leaf[at] = found
                for i, row in zip(at.tolist(), stacked if whole else (), strict=whole):
                    data[i] = row.tobytes()
            out = {n: batch.column(n) for n in batch.schema.names if n != "v"} | {"leaf": leaf}
            yield pa.RecordBatch.from_pydict(out | ({"data": pa.array(data, pa.binary())} if whole else {}))

    bounds = spark.createDataFrame([(d, most[d], together[d]) for d in sizes], "dim int, most int, together int")  # a row per vector length
    counted = classes.select("dim", "v").mapInArrow(lay_out, "dim int, leaf long").groupBy("dim", "leaf").count().join(F.broadcast(bounds), "dim")
    counted = counted.withColumn("parts", F.ceil(F.col("count") / F.col("most")).cast("long"))
    before = Window.partitionBy("dim").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    full = cut(counted.select("dim", "leaf", "parts", "together", F.coalesce(F.sum("parts").over(before), F.lit(0)).alias("first")))  # a row per leaf, at most 4096 a length
    least = vectors.schema[vec_id].dataType.simpleString()
    laid = classes.select("ck", "least", "n", "dim", "v").mapInArrow(lay_out, f"ck string, least {least}, n long, dim int, leaf long, data binary")
    placed = laid.join(F.broadcast(full), ["dim", "leaf"]).withColumn("at", F.col("first") + F.pmod(F.xxhash64("ck"), F.col("parts")))
    number = lambda at: F.shiftleft(F.col("dim").cast("long"), 40) + at
    packs = placed.groupBy("dim", number(F.col("at")).alias("chunk"), number(F.floor(F.col("at") / F.col("together"))).alias("part")).agg(F.collect_list(F.struct("ck", "least", "n", "data")).alias("m"))

    def boxes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packs with their boxes in rotated coordinates, the vectors joined to one value."""
        for batch in batches:
            for k in range(batch.num_rows):
                dim, members = batch.column("dim")[k].as_py(), batch.column("m")[k].values
                joined = b"".join(members.field("data").to_pylist())
                turned = unit(np.frombuffer(joined, kind).reshape(-1, dim).astype(np.float64)) @ rotation(dim)
                lists = {f"{n}s": pa.ListArray.from_arrays(pa.array([0, len(members)], pa.int32()), members.field(n)) for n in ("ck", "least", "n")}
                one = {n: batch.column(n).slice(k, 1) for n in ("dim", "chunk", "part")}
                yield pa.RecordBatch.from_pydict(one | lists | {"data": pa.array([joined], pa.binary()), "lo": [turned.min(axis=0).tolist()], "hi": [turned.max(axis=0).tolist()]})

    # few rows a file, as a reader takes many rows at once
    packs = packs.mapInArrow(boxes, f"dim int, chunk long, part long, cks array<string>, leasts array<{least}>, ns array<long>, data binary, lo array<double>, hi array<double>")
    packs = stage(packs, "zstd", 16)
    discard(classes)
    total = sum(dim * count * kind.itemsize for dim, count in sizes.items())
    return _join_packs(spark, rows.select("vec_id", "ck"), packs, cosine, kind, max(ROUND, total), sum(sizes.values()))


def _join_packs(spark, rows: DataFrame, packs: DataFrame, cosine: float, kind: np.dtype, sent: int, members: int) -> DataFrame:
    """The result from packs; a round sends about ``sent`` bytes."""
    budget = max(0.0, 2 - 2 * cosine)
    # the leading coordinate of each block and its radius, for each vector length
    ranges = []
    for r in packs.select("dim").distinct().collect():
        for lo, hi in block_edges(r["dim"]):
            ranges.append((r["dim"], lo, hi, float(np.sqrt(budget * (hi - lo) / r["dim"])) + 1e-6))
    table = spark.createDataFrame(ranges, "dim int, first int, last int, radius double")
    meta = packs.select("dim", "chunk", "part", "lo", "hi").join(F.broadcast(table), "dim")  # a few rows for each length
    cell = lambda x: F.floor(x / F.col("radius")).cast("long")
    low, high = F.get("lo", F.col("first")), F.get("hi", F.col("first"))
    home = meta.select("dim", "first", "last", "radius", F.col("chunk").alias("a"), F.col("part").alias("apart"), F.col("lo").alias("alo"), F.col("hi").alias("ahi"), F.explode(F.sequence(cell(low), cell(high))).alias("cell"))
    wide = meta.select("dim", "first", F.col("chunk").alias("b"), F.col("part").alias("bpart"), F.col("lo").alias("blo"), F.col("hi").alias("bhi"), F.explode(F.sequence(cell(low - F.col("radius")), cell(high + F.col("radius")))).alias("cell"))
    apart = F.zip_with(F.zip_with("alo", "bhi", lambda x, y: x - y), F.zip_with("blo", "ahi", lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0.0)))
    square = lambda gaps: F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x * x)
    inside = (square(F.slice("gaps", F.col("first") + 1, F.col("last") - F.col("first"))) <= F.col("radius") * F.col("radius")) & (square(F.col("gaps")) <= budget + 1e-6)
    met = home.join(wide, ["dim", "first", "cell"]).where("a <= b").withColumn("gaps", apart).where(inside)
    pairs = stage(met.select("a", "b", "apart", "bpart").distinct())
    # two groups a task: numbers of groups, a few thousandths of the pairs
    tasks = sorted((r["apart"], r["bpart"]) for r in pairs.select("apart", "bpart").distinct().collect())
    each = max(1, sent // (2 * GROUP))

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(ck, to, n) of a task's chunks: each vector's links and the root of its links, in one forest."""
        chunks, partners = {}, []
        for batch in batches:
            for k in range(batch.num_rows):
                row = {n: batch.column(n)[k] for n in batch.schema.names}
                data = np.frombuffer(row["data"].as_buffer(), kind).reshape(-1, row["dim"].as_py()).astype(np.float64)
                chunks[row["chunk"].as_py()] = (data, row["ns"].values.to_numpy(zero_copy_only=False), row["cks"].values)
                partners += [(row["chunk"].as_py(), b) for b in row["partners"].as_py()]
        if not partners:
            return
        names = sorted(chunks)
        start = dict(zip(names, np.cumsum([0] + [len(chunks[c][0]) for c in names]).tolist()))
        count = sum(len(chunks[c][0]) for c in names)
        found, edges = np.zeros(count, np.int64), []
        for one, other in sorted(partners):
            (a, na, _), (b, nb, _) = chunks[one], chunks[other]
            same = one == other
            i, j = compare(a, b, same, cosine)
            if not len(i):
                continue
            found[start[one] : start[one] + len(a)] += np.bincount(i, nb[j], len(a)).astype(np.int64)
            found[start[other] : start[other] + len(b)] += np.bincount(j, na[i], len(b)).astype(np.int64)
            at = np.concatenate([start[one] + np.arange(len(a)), start[other] + np.arange(0 if same else len(b))])
            root = forest(len(at), i, j if same else j + len(a))
            moved = np.flatnonzero(root != np.arange(len(at)))
            edges.append((at[moved], at[root[moved]]))
        touched = np.flatnonzero(found)
        if len(touched):
            root = forest(count, *[np.concatenate(x) for x in zip(*edges)])
            keys = pa.concat_arrays([chunks[c][2] for c in names])
            yield pa.RecordBatch.from_pydict({"ck": keys.take(pa.array(touched)), "to": keys.take(pa.array(root[touched])), "n": found[touched]})

    found, held = [], 0
    for top in range(0, len(tasks), each):
        now = tasks[top : top + each]
        numbered = spark.createDataFrame([(a, b, k) for k, (a, b) in enumerate(now)], "apart long, bpart long, task int")
        mine = pairs.where(F.col("apart").between(now[0][0], now[-1][0])).join(F.broadcast(numbered), ["apart", "bpart"])
        sides = mine.select("task", F.col("a").alias("chunk"), F.array("b").alias("partners")).unionByName(mine.select("task", F.col("b").alias("chunk"), F.array().cast("array<long>").alias("partners")))
        sends = sides.groupBy("task", "chunk").agg(F.flatten(F.collect_list("partners")).alias("partners"))
        work = packs.select("chunk", "dim", "cks", "ns", "data").join(F.broadcast(sends), "chunk").repartitionById(len(now), "task")
        found.append(stage(work.mapInArrow(links, "ck string, to string, n long"), "zstd"))
        held += found[-1].count()
        if held > LINKS * members and len(found) > 1:
            found = [_reduced(found)]
            held = found[0].count()
    every = found[0] if found else spark.createDataFrame([], "ck string, to string, n long")
    for more in found[1:]:
        every = every.unionByName(more)
    counted = every.groupBy("ck").agg(F.sum("n").alias("links"))
    roots = components(every.select(F.col("ck").alias("a"), F.col("to").alias("b")))
    classes = packs.select(F.explode(F.arrays_zip("cks", "leasts", "ns")).alias("m")).select(F.col("m.cks").alias("ck"), F.col("m.leasts").alias("least"), F.col("m.ns").alias("n"))
    # classes without a link keep to themselves; the others' least ids meet them by root and salt, so that no large component is one task
    known = classes.join(roots.withColumnRenamed("node", "ck"), "ck", "left").withColumn("salt", F.pmod(F.xxhash64(F.lit(9), "ck"), F.lit(SALTS)))
    smallest = known.where("root is not null").groupBy("root").agg(F.min("least").alias("of_all"))
    salted = smallest.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    told = known.where("root is not null").join(salted, ["root", "salt"]).drop("salt").unionByName(known.where("root is null").withColumn("of_all", F.col("least")).drop("salt"))
    judged = told.join(counted, "ck", "left").withColumnRenamed("of_all", "component_id")
    judged = judged.select("ck", "component_id", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).cast("long").alias("n_links"))
    judged = stage(judged, "zstd")
    for made in (packs, pairs, *found):
        discard(made)
    out = rows.join(judged, "ck", "left")
    component = F.when(F.col("ck").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def _reduced(found: list[DataFrame]) -> DataFrame:
    """Links of several rounds as a row a vector: its links so far, and the root that all of them reach."""
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    counted = every.groupBy("ck").agg(F.sum("n").alias("n"))
    roots = components(every.select(F.col("ck").alias("a"), F.col("to").alias("b"))).withColumnRenamed("node", "ck")
    made = stage(counted.join(roots, "ck", "left").select("ck", F.coalesce("root", "ck").alias("to"), "n"), "zstd")
    for old in found:
        discard(old)
    return made
