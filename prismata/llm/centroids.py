"""Centroid clustering in exact integers, screened by block norms.

The norms of a vector's segments are computed once.  Against a centroid's they
give a lower bound of the distance (Cauchy-Schwarz: two segments lie no nearer
than their norms differ), and only centroids whose bound doesn't exceed the
least distance found so far get an exact integer one.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released, small_batches, stash, table

#: Segments of a vector; integers up to this size are summed and squared in 64 bits, larger ones as Python's.
SEGMENTS, NARROW = 8, 1 << 27
MOST = (1 << 63) - 1
LIMB = 32


def integers(x: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of each row as int64 (0 where too wide), and which rows are too wide for it."""
    wide = (np.abs(x) > (NARROW - 1) / scale).any(1)
    return np.floor(np.where(wide[:, None], 0.0, x) * scale).astype(np.int64), wide


def wide_integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) as Python's integers, of any size."""
    exact = [int(v) * scale if abs(v) >= 1 << 53 else math.floor(v * scale) for v in x.ravel().tolist()]
    out = np.empty(len(exact), object)
    out[:] = exact
    return out.reshape(x.shape)


def segment_norms(values: np.ndarray) -> np.ndarray:
    """Norms of each row's segments."""
    parts = np.array_split(values, min(SEGMENTS, values.shape[1]), axis=1)
    squares = np.stack([(p * p).sum(1) for p in parts], 1)
    if squares.dtype != object:
        return np.sqrt(squares.astype(np.float64))
    return np.array([[float(min(math.isqrt(q), 10**150)) for q in row] for row in squares], np.float64)


def lower_bounds(norms: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Rows x centroids: no squared distance is less, rounding included."""
    a, b = norms[:, None, :], others[None, :, :]
    apart = np.maximum(0.0, np.abs(a - b) - (a + b) * 2.0**-50)
    return (apart * apart).sum(2) * (1 - 2.0**-45)


class Nearest:
    """The nearest of some centroids (lists of integers), ties to the smaller number."""

    def __init__(self, centroids: list[list[int]]):
        self.wide = np.array([any(abs(v) > NARROW for v in c) for c in centroids])
        self.exact = np.empty((len(centroids), len(centroids[0])), object)
        self.exact[:] = centroids
        self.small = np.where(self.wide[:, None], 0, self.exact).astype(np.int64)
        self.norms = segment_norms(self.exact)
        self.tried = 0

    def __call__(self, values: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance (int64, or Python's integers for those) for rows of integers."""
        if values.dtype == object or self.wide.all():
            apart = np.stack([((values - c) ** 2).sum(1) for c in self.exact], 1)
            self.tried += apart.size
            best = np.array([min(range(len(row)), key=lambda j: (row[j], j)) for row in apart], np.int64)
            return best, apart[np.arange(len(best)), best]
        bounds = lower_bounds(norms, self.norms)
        best = np.where(self.wide, np.inf, bounds).argmin(1)
        least = ((values - self.small[best]) ** 2).sum(1)
        self.tried += len(values)
        first = best.copy()
        for j in range(len(self.exact)):
            rows = np.flatnonzero((bounds[:, j] <= least) & (first != j))
            if not len(rows):
                continue
            self.tried += len(rows)
            apart = ((values[rows] - (self.exact[j] if self.wide[j] else self.small[j])) ** 2).sum(1)
            nearer = (apart < least[rows]) | ((apart == least[rows]) & (j < best[rows]))
            best[rows[nearer]], least[rows[nearer]] = j, apart[nearer]
        return best, least


def assigned(batch: pa.RecordBatch, nearest: Nearest, scale: int):
    """For the narrow and the wide rows of a batch (x, norms): their places, integers, cluster and distance."""
    n = batch.num_rows
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    norms = batch.column("norms").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    values, wide = integers(x, scale)
    for rows in (np.flatnonzero(~wide), np.flatnonzero(wide)):
        if len(rows):
            own = wide_integers(x[rows], scale) if wide[rows[0]] else values[rows]
            yield rows, own, *nearest(own, norms[rows])


def limbs(values: list[int]) -> list[list[int]]:
    """Digits to the base 2**32 of some integers, lowest first: all but the last digits are not negative."""
    out = []
    while any(abs(v) >> (LIMB + 30) for v in values):
        out.append([v & ((1 << LIMB) - 1) for v in values])
        values = [v >> LIMB for v in values]
    return [*out, values]


def new_centroids(kept: DataFrame, centroids: list[list[int]], scale: int) -> list[list[int]]:
    """Floors of the means of the vectors nearest to each centroid; those without a vector stay.

    A task sends one sum a cluster (or several digits of a very wide one), so
    what is shuffled doesn't grow with the vectors.
    """
    dims = len(centroids[0])

    def work(batches):
        nearest = Nearest(centroids)
        counts, sums = [0] * len(centroids), [[0] * dims for _ in centroids]
        for batch in batches:
            for _, own, best, _ in assigned(batch, nearest, scale) if batch.num_rows else ():
                for j in np.unique(best).tolist():
                    rows = best == j
                    counts[j] += int(rows.sum())
                    sums[j] = [a + int(b) for a, b in zip(sums[j], own[rows].sum(0))]
        rows = [(j, k, counts[j] if k == 0 else 0, digits) for j in range(len(centroids)) if counts[j] for k, digits in enumerate(limbs(sums[j]))]
        columns = zip(*rows) if rows else ([],) * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())))], ["cluster", "digit", "n", "sums"])

    parts = kept.select("x", "norms").mapInArrow(released(work), "cluster int, digit int, n long, sums array<long>")
    totals: dict[int, tuple[int, list[int]]] = {}
    for r in parts.groupBy("cluster", "digit").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[i]) for i in range(dims)]).alias("sums")).collect():  # a row a cluster and digit
        n, sums = totals.get(r["cluster"], (0, [0] * dims))
        totals[r["cluster"]] = n + r["n"], [s + (v << (LIMB * r["digit"])) for s, v in zip(sums, r["sums"])]
    return [[s // totals[j][0] for s in totals[j][1]] if j in totals else c for j, c in enumerate(centroids)]


def usable_vectors(vectors: DataFrame, dims: int, scale: int) -> DataFrame:
    """vec_id, x and the norms of its segments, of vectors with ``dims`` components, none null or not finite."""
    small_batches(vectors.sparkSession)
    finite = F.forall("embedding", lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.where((F.size("embedding") == dims) & finite).select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>").alias("x"))

    def work(batches):
        for batch in batches:
            if batch.num_rows:
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
                norms = segment_norms(integers(x, scale)[0])
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array(list(norms), pa.list_(pa.float64()))], ["vec_id", "x", "norms"])

    return rows.mapInArrow(released(work), "vec_id long, x array<double>, norms array<double>")


def cluster_vectors(vectors: DataFrame, clusters: int = 8, rounds: int = 10, dims: int = 64, scale: int = 1024, salt: str = "3") -> tuple[DataFrame, list[list[int]]]:
    """vec_id, cluster, distance for each usable vector, and the centroids.

    A vector is usable if it has ``dims`` components, none of them null, NaN or
    infinite; its components become floor(scale * x).  The first centroids are
    the vectors with the smallest SHA-256 of ``salt:vec_id`` (a null id comes
    last, ties go by components; all of them if there are fewer), and each round
    replaces those that have vectors by the floors of their means.  Distances
    are squared and exact; those beyond a long are given as the largest one.
    Repeated rows count each; an empty table gives no rows and no centroids;
    other columns are left out.
    """
    kept = stash(usable_vectors(vectors, dims, scale), "vectors")
    first = kept.orderBy(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).asc_nulls_last(), "x").limit(clusters)
    centroids = [wide_integers(np.array([r["x"]]), scale)[0].tolist() for r in first.select("x").collect()]
    schema = "vec_id long, cluster int, distance long"
    if not centroids:
        return kept.sparkSession.createDataFrame([], schema), []
    for _ in range(rounds):
        centroids = new_centroids(kept, centroids, scale)

    def work(batches):
        nearest = Nearest(centroids)
        for batch in batches:
            if batch.num_rows:
                cluster, distance = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
                for rows, _, best, least in assigned(batch, nearest, scale):
                    cluster[rows] = best
                    distance[rows] = np.array([min(int(d), MOST) for d in least], np.int64) if least.dtype == object else least
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(cluster), pa.array(distance)], ["vec_id", "cluster", "distance"])

    return kept.mapInArrow(released(work), schema), centroids


def op11_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    found, centroids = cluster_vectors(table(spark, sf_dir, "embeddings"))
    found = stash(found, "clusters")
    sums = dict(found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect())  # a row a cluster
    total = min(int(sum(sums.values())), MOST)
    rows = [(j, min(int(s), MOST), total, hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for j, s in sums.items()]
    figures = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(figures), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _rounds(n: int) -> str:
    """Assignment and means of one round after another, as common table expressions."""
    out = ""
    for r in range(n + 1):
        out += f""",
a{r} AS MATERIALIZED (SELECT i, vec_id, v, arg_min(k, d * 64 + k) AS k, min(d) AS d FROM (
  SELECT i, vec_id, v, k, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT AS d FROM kept, c{r}) GROUP BY i, vec_id, v)"""
        if r < n:
            out += f""",
m{r} AS (SELECT k, j, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range(1, 65)) AS j FROM a{r}) GROUP BY k, j),
c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(n.c, c{r}.c) AS c FROM c{r} LEFT JOIN (
  SELECT k, list((s - ((s % n + n) % n)) // n ORDER BY j) AS c FROM m{r} GROUP BY k) n ON n.k = c{r}.k)"""
    return out


ORACLE_SQL = f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS i, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('3:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT 8)){_rounds(10)}
SELECT vec_id, a10.k::INTEGER AS cluster, d AS distance, sum(d) OVER (PARTITION BY a10.k)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(c, ',')) AS centroid_sha256
FROM a10 JOIN c10 ON c10.k = a10.k
"""
