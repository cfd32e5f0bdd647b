"""Centroid clustering with n-simplex projection.

Vectors are turned into integers once.  The starting centroids serve as pivots: a vector's distances to them, with the
distances among them, place it as the apex of a simplex in as many dimensions as there are pivots, and the apex is kept
with the vector.  The Euclidean distance of two apexes is a lower bound of the distance of what they stand for, and with
one apex mirrored at the base it is an upper bound.  A round projects the few centroids, rules out those whose lower
bound exceeds the least upper bound, and compares integers exactly where more than one is left.

Rounds read one written table.  A task gives a count and a sum for each centroid, so a round moves a few rows a task
whatever the clusters' sizes; centroids, bounded in number, are all that the driver sees.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stage
from .vectors import finite

CENTROIDS, DIM, SCALE, ROUNDS, SEED = 8, 64, 1024, 10, 3
#: Share of the largest distance among pivots that a pivot must rise above the base of those before it.
FLAT = 1e-3
#: Share of the largest square in play by which a bound may be off.
SLACK = 1e-7


def limit(dim: int) -> int:
    """What components are held within, so that squared distances of ``dim`` of them fit a long."""
    return 1 << ((62 - (dim - 1).bit_length()) // 2 - 1)


def squares(q: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of integers and one or as many others."""
    gap = q - centre
    return np.einsum("ij,ij->i", gap, gap)


@dataclass(frozen=True)
class Simplex:
    """Pivots and the corner coordinates of their simplex: a lower triangle, one row for each pivot after the first."""

    pivots: np.ndarray
    corners: np.ndarray

    @classmethod
    def over(cls, points: np.ndarray) -> Simplex:
        """The simplex of the points that aren't (nearly) in the base of those before them."""
        points = np.asarray(points, np.int64)
        apart = np.sqrt(np.array([squares(points, p) for p in points]).astype(np.float64)).max(initial=0.0)
        chosen, corners = points[:1], np.zeros((0, 0))
        for p in points[1:]:
            one = cls(chosen, corners)
            apex = one.apexes(p[None, :])[0]
            if len(apex) and apex[-1] > FLAT * apart:
                corners = np.vstack([np.pad(corners, ((0, 0), (0, 1))), apex])
                chosen = np.vstack([chosen, p])
        return cls(chosen, corners)

    def apexes(self, q: np.ndarray) -> np.ndarray:
        """The apex of each row of integers over the pivots; the last coordinate is the height over their base."""
        if not len(self.pivots):
            return np.zeros((len(q), 0))
        away = np.stack([squares(q, p) for p in self.pivots], axis=1).astype(np.float64)
        # the first coordinates follow from the differences of squared distances
        right = (away[:, :1] - away[:, 1:] + (self.corners**2).sum(axis=1)) / 2
        base = np.linalg.solve(self.corners, right.T).T if len(self.corners) else np.zeros((len(q), 0))
        return np.hstack([base, np.sqrt(np.maximum(0.0, away[:, 0] - (base**2).sum(axis=1)))[:, None]])


def nearest(q: np.ndarray, apexes: np.ndarray, centres: np.ndarray, tops: np.ndarray) -> tuple[np.ndarray, int]:
    """The nearest of the ``centres`` (with apexes ``tops``) of each row, ties to the first, and how many pairs were compared exactly."""
    base = ((apexes[:, None, :-1] - tops[None, :, :-1]) ** 2).sum(axis=2)
    lower = base + (apexes[:, None, -1] - tops[None, :, -1]) ** 2
    upper = base + (apexes[:, None, -1] + tops[None, :, -1]) ** 2
    slack = SLACK * (1.0 + (apexes**2).sum(axis=1).max(initial=0.0) + (tops**2).sum(axis=1).max(initial=0.0))
    open_ = lower <= upper.min(axis=1, keepdims=True) + slack
    found = open_.argmax(axis=1)
    rows = np.flatnonzero(open_.sum(axis=1) > 1)
    if not len(rows):
        return found, 0
    i, j = np.nonzero(open_[rows])
    exact = np.full((len(rows), len(centres)), np.iinfo(np.int64).max)
    exact[i, j] = squares(q[rows[i]], centres[j])
    found[rows] = exact.argmin(axis=1)
    return found, len(i)


def matrix(column: pa.Array, width: int, kind: type) -> np.ndarray:
    """Lists of equal length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), width)


def moved(sums: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The next centroids from (cluster, n, sums): floors of exact means; those without a vector stay."""
    after = centres.copy()
    total = sums.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(centres.shape[1])])
    for row in total.collect():  # a row for each centroid
        after[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(centres.shape[1])]
    return after


def cluster(
    vectors: DataFrame, *, k: int = CENTROIDS, dim: int = DIM, scale: int = SCALE, rounds: int = ROUNDS, seed: int = SEED, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(vec_id, cluster int, distance, cluster_inertia, inertia long, centroid_sha256) for each kept row of ``vectors``.

    Kept are vectors of exactly ``dim`` components, none null or non-finite; others give no row, and an empty table none.
    Components are floor(scale * x), held within limit(dim), far beyond which squares would leave a long.  Centroids
    start as the k vectors of smallest sha256 of "seed:vec_id" (null ids as "seed:"), equal ids by their vectors; with
    fewer rows there are fewer centroids.  Repeated rows count as often as they are there; where they start as equal
    centroids, ties give all to the first and the others stay empty.  An inertia beyond the range of a long is given as
    its end.  Other columns are not looked at.
    """
    most = limit(dim)
    held = lambda x: F.floor(F.greatest(F.lit(float(-most)), F.least(F.lit(float(most)), x.cast("double") * scale))).cast("int")
    kept = vectors.where(finite(F.col(vector)) & (F.size(vector) == dim)).select(F.col(vec_id).alias("vec_id"), F.transform(vector, held).alias("q"))
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = kept.select("q", order.alias("h")).orderBy("h", "q").limit(k).collect()
    centres = np.array([r["q"] for r in first], np.int64).reshape(-1, dim)
    simplex = Simplex.over(centres)
    kind = kept.schema["vec_id"].dataType.simpleString()

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apexes = simplex.apexes(matrix(batch["q"], dim, np.int64))
            lists = pa.ListArray.from_arrays(np.arange(0, apexes.size + 1, apexes.shape[1] or 1, dtype=np.int32), apexes.ravel()) if apexes.size else pa.array([[]] * len(apexes), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["q"], lists], names=["vec_id", "q", "apex"])

    rows = stage(kept.mapInArrow(project, f"vec_id {kind}, q array<int>, apex array<double>"))
    width = len(simplex.pivots)

    def sums_by(centres: np.ndarray):
        tops = simplex.apexes(centres)

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            n, total = np.zeros(len(centres), np.int64), np.zeros((len(centres), dim), np.int64)
            for batch in batches:
                q = matrix(batch["q"], dim, np.int64)
                found, _ = nearest(q, matrix(batch["apex"], width, np.float64), centres, tops)
                n += np.bincount(found, minlength=len(centres))
                np.add.at(total, found, q)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": pa.array(n[some]), "sums": pa.array(total[some].tolist(), pa.list_(pa.int64()))})

        return sums

    for _ in range(rounds if len(centres) else 0):
        after = moved(rows.select("q", "apex").mapInArrow(sums_by(centres), "cluster int, n long, sums array<long>"), centres)
        if (after == centres).all():
            break  # all further rounds would give the same
        centres = after
    tops = simplex.apexes(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = matrix(batch["q"], dim, np.int64)
            found, _ = nearest(q, matrix(batch["apex"], width, np.float64), centres, tops)
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(found, pa.int32()), pa.array(squares(q, centres[found]))], names=["vec_id", "cluster", "distance"])

    assigned = stage(rows.mapInArrow(assign, f"vec_id {kind}, cluster int, distance long"))
    inertias = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row for each centroid
    end = (1 << 63) - 1
    whole = min(end, sum(inertias.values()))
    told = [(c, min(end, s), whole, hashlib.sha256(",".join(map(str, centres[c].tolist())).encode()).hexdigest()) for c, s in sorted(inertias.items())]
    about = vectors.sparkSession.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
