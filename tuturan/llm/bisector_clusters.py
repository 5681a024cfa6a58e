"""Exact integer k-means in which a tournament of bisectors finds the nearest centroid.

For two centroids a < b the points nearer to b are those with v . 2(b - a) > |b|^2 - |a|^2. Normals
and thresholds of all pairs are worked out once a round. A vector then meets the centroids in
ascending order: k - 1 sign tests, in each of which the loser is out, and zero favours the smaller
number. Only the distance to the winner is computed.

A round sends the centroids to the tasks, which return sums and counts by cluster, so no vector is
shuffled and no cluster, whatever its share of the rows, is gathered anywhere.

Rules: only vectors of exactly ``DIMENSIONS`` components, none null or non-finite, take part; a null
id counts as the last in the choice of first centroids; repeated rows each count and each give a
row; with fewer vectors than centroids every vector is a first centroid; no vectors give no rows.
Components must lie within 2^19 either way, else a squared distance might not fit a long, and the
job fails with that message. Columns other than id and vector do not matter, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tuturan.llm.common import append_arrow, write_once

DIMENSIONS, CENTROIDS, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256
LARGEST = 1 << 27  # of a scaled component: 64 squared differences of 2^28 fit a long
NORMAL_BYTES = 256 << 20  # of the normals a task holds
TOGETHER = 2048  # vectors in one step of the tournament


def _usable(vector: Column, dimensions: int) -> Column:
    real = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return (F.size(vector) == dimensions) & F.forall(vector.cast("array<double>"), real)


def _scaled(vector: Column, scale: int) -> Column:
    def one(x: Column) -> Column:
        whole = x * F.lit(float(scale))
        far = F.raise_error(F.lit("a component is too large for exact distances"))
        return F.when(F.abs(whole) < float(LARGEST), F.floor(whole).cast("int")).otherwise(far.cast("int"))

    return F.transform(vector.cast("array<double>"), one)


def integer_vectors(
    vectors: DataFrame, name: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE
) -> DataFrame:
    """``vec_id`` and ``point`` (floor of scaled components) of the vectors that take part."""
    kept = F.coalesce(_usable(F.col(name), dimensions), F.lit(False))
    # a tested vector, else null: the scaling then never sees the others
    point = F.when(kept, _scaled(F.col(name), scale))
    return vectors.select("vec_id", point.alias("point")).where("point is not null")


def first_centroids(points: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> np.ndarray:
    """The points of the k least hashes of seed and id, in the order of the hashes."""
    place = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    order = [F.asc_nulls_last("_place"), F.asc("point")]
    rows = points.select("point", place.alias("_place")).orderBy(*order).limit(k).collect()  # k rows
    return np.array([r["point"] for r in rows], dtype=np.int64)


class Tournament:
    """Normals and thresholds of all pairs of centroids."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        squares = (centroids * centroids).sum(axis=1)
        # [a, b] for a < b; the other half is never asked
        self.normals = 2 * (centroids[None, :, :] - centroids[:, None, :])
        self.thresholds = squares[None, :] - squares[:, None]

    def winners(self, points: np.ndarray) -> np.ndarray:
        """The nearest centroid of each point, the smaller number where two are as near."""
        out = np.zeros(len(points), dtype=np.int64)
        for start in range(0, len(points), TOGETHER):
            some = points[start : start + TOGETHER]
            held = out[start : start + TOGETHER]
            for rival in range(1, len(self.centroids)):
                side = np.einsum("ij,ij->i", some, self.normals[held, rival])
                held[side > self.thresholds[held, rival]] = rival
        return out

    def distances(self, points: np.ndarray, found: np.ndarray) -> np.ndarray:
        apart = points - self.centroids[found]
        return np.einsum("ij,ij->i", apart, apart)


def _points(batch: pa.RecordBatch, dimensions: int) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index("point"))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dimensions)


def _check_size(centroids: np.ndarray) -> None:
    if len(centroids) * centroids.size * 8 > NORMAL_BYTES:
        raise ValueError(f"{len(centroids)} centroids have more normals than a task should hold")


def sums(points: DataFrame, centroids: np.ndarray) -> list[tuple[int, int, list[int]]]:
    """Number and exact componentwise sum of the points of each non-empty cluster (at most k rows)."""
    dimensions = centroids.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        games = Tournament(centroids)
        count = np.zeros(len(centroids), dtype=np.int64)
        total = np.zeros(centroids.shape, dtype=np.int64)
        for batch in batches:
            some = _points(batch, dimensions)
            found = games.winners(some)
            count += np.bincount(found, minlength=len(count))
            np.add.at(total, found, some)
        used = np.flatnonzero(count)
        columns = [used, count[used]]
        yield pa.RecordBatch.from_arrays(
            [*map(pa.array, columns), pa.array(total[used].tolist(), pa.list_(pa.int64()))],
            ["cluster", "n", "total"],
        )

    parts = points.select("point").mapInArrow(run, "cluster long, n long, total array<long>")
    exact = "decimal(38,0)"
    added = [F.sum(F.col("total")[i].cast(exact)) for i in range(dimensions)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*added).alias("total")).collect()
    return [(r["cluster"], r["n"], [int(x) for x in r["total"]]) for r in rows]


def moved(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floored means; an empty cluster keeps its own."""
    out = centroids.copy()
    for cluster, n, total in sums(points, centroids):
        out[cluster] = [x // n for x in total]
    return out


def assigned(points: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``points`` with ``cluster`` and ``distance``, the squared distance to its centroid."""
    dimensions = centroids.shape[1]

    def make():
        games = Tournament(centroids)

        def work(batch):
            some = _points(batch, dimensions)
            found = games.winners(some)
            return [pa.array(found, pa.int32()), pa.array(games.distances(some, found), pa.int64())]

        return work

    fields = [("cluster", T.IntegerType()), ("distance", T.LongType())]
    return append_arrow(points, fields, make)


def cluster(
    vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED, **shape
) -> tuple[DataFrame, np.ndarray]:
    """Points with their clusters, and the final centroids."""
    points = write_once(integer_vectors(vectors, **shape), "points")
    centroids = first_centroids(points, k, seed)
    if not len(centroids):
        none = points.withColumn("cluster", F.lit(0)).withColumn("distance", F.lit(0).cast("long"))
        return none, centroids
    _check_size(centroids)
    for _ in range(rounds):
        centroids = moved(points, centroids)
    return write_once(assigned(points, centroids), "clusters"), centroids


def digest(vectors: DataFrame) -> DataFrame:
    """Every vector's cluster and distance, its cluster's and the whole inertia, and its centroid's hash."""
    found, centroids = cluster(vectors)
    by_cluster = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("inertia"))
    inertia = {r["cluster"]: int(r["inertia"]) for r in by_cluster.collect()}  # at most k rows
    rows = [
        (c, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, row)).encode()).hexdigest())
        for c, row in enumerate(centroids.tolist())
        if c in inertia
    ]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    of_cluster = found.sparkSession.createDataFrame(rows, schema)
    return found.select("vec_id", "cluster", "distance").join(F.broadcast(of_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def _oracle() -> str:
    nearest = """SELECT k.r, (min({{'d': CAST(list_sum(list_transform(list_zip(k.v, c.v),
        lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT), 'c': c.c}})) AS best
      FROM kept k CROSS JOIN c{0} c GROUP BY k.r"""
    steps = [
        f"""kept AS MATERIALIZED (
      SELECT row_number() OVER () AS r, vec_id,
        list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings
      WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: isfinite(x))) = {DIMENSIONS})""",
        f"""c0 AS MATERIALIZED (
      SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v
      FROM (SELECT sha256('{SEED}:' || vec_id) AS h, v FROM kept ORDER BY h, v LIMIT {CENTROIDS}))""",
    ]
    for i in range(ROUNDS):
        steps += [
            f"a{i} AS MATERIALIZED ({nearest.format(i)})",
            f"""m{i} AS MATERIALIZED (
      SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY p) AS v
      FROM (SELECT a.best.c AS c, p, sum(k.v[p]) AS s, count(*) AS n
            FROM a{i} a JOIN kept k USING (r) CROSS JOIN range(1, {DIMENSIONS + 1}) t(p) GROUP BY ALL)
      GROUP BY c)""",
            f"""c{i + 1} AS MATERIALIZED (
      SELECT c.c, CAST(coalesce(m.v, c.v) AS BIGINT[]) AS v FROM c{i} c LEFT JOIN m{i} m USING (c))""",
        ]
    return f"""WITH {', '.join(steps)},
    last AS MATERIALIZED ({nearest.format(ROUNDS)})
    SELECT k.vec_id, CAST(l.best.c AS INTEGER) AS cluster, l.best.d AS distance,
      CAST(sum(l.best.d) OVER (PARTITION BY l.best.c) AS BIGINT) AS cluster_inertia,
      CAST(sum(l.best.d) OVER () AS BIGINT) AS inertia,
      sha256(array_to_string(c.v, ',')) AS centroid_sha256
    FROM last l JOIN kept k USING (r) JOIN c{ROUNDS} c ON c.c = l.best.c""".replace("{{", "{").replace("}}", "}")


ORACLE = _oracle()
