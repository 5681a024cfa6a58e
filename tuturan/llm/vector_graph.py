"""Embedding near-duplicates by a robust-pruned flat graph over overlapping cluster shards.

Equal vectors are one node. Centroids are fitted on a bounded sample; those that split one dense
group, all within the radius of one of them, are one shard. Nodes go to the shards of their nearest
centroids; a shard that would be too large is dealt into parts that are all compared. In every part the nearest nodes and
some random ones are pruned to a sparse graph in which a neighbour is dropped where another one is
closer to it by a factor; the adjacency lists that a node gets in all its shards are united. Each
part's nodes then search the united graph of every part of their shard: a greedy search with a beam
begins at the medoid, and from all places near the radius it expands through neighbours until
nothing new is in range. Pairs are verified by their cosine in double precision. Counts of links and
a spanning forest leave a task, never all pairs; a pair that meets in several shards counts in the
first. ``recall`` audits the links of every hundredth vector against a comparison with all rows.

Vectors that are null, zero, hold null or non-finite components or have another length than most
link with nothing. A row with a null ``vec_id`` is compared but never names a component, unless all
its ids are null. Repeated rows count as vectors of their own; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F, types as T

from tuturan.llm.common import append_arrow, write_once
from tuturan.llm.components import components
from tuturan.llm.simhash import forest

CUT = 0.95
SHARD, PART = 1024, 2048  # nodes of a shard as centroids are chosen; nodes of a part at most, about
CENTROIDS = 4096  # at most
SAMPLE = 32_768  # nodes that centroids are fitted on, and no more than 32 for each centroid
OVERLAP = 3  # shards of a node at least
MOST_SHARDS = 48  # and at most
AUDITED = 512  # nodes whose neighbours are sought among all, before shards are dealt out
WANTED, LEAST = 0.97, 0.9  # share of their pairs that meet in a shard: aimed at, and demanded
TILE = 8192  # rows that the audit compares with at once, about
DEGREE, NEAR, FAR, ALPHA = 24, 48, 16, 1.2
BEAM, SLACK = 24, 0.15
QUERIES = 256  # queries that search together


def normalised(values: list[list[float] | None], length: int) -> list[bytes | None]:
    """Unit vectors in double precision as bytes; None for what cannot be compared."""
    out: list[bytes | None] = []
    for v in values:
        x = None
        if v is not None and len(v) == length and length and None not in v:
            x = np.asarray(v, dtype=np.float64)
            top = np.abs(x).max()
            x = x / top if np.isfinite(top) and top > 0 else None
        out.append(None if x is None else (x / np.sqrt(x @ x)).tobytes())
    return out


def _nodes(vectors: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """All rows with their unit vector, and the distinct unit vectors as numbered nodes."""
    sizes = vectors.where("embedding is not null").groupBy(F.size("embedding").alias("d"))
    most = sizes.count().orderBy(F.desc("count"), "d").limit(1).collect()
    length = most[0]["d"] if most else 0

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            column = batch.column(batch.schema.get_field_index("embedding"))
            return [pa.array(normalised(column.to_pylist(), length), pa.binary())]

        return work

    chosen = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    rows = write_once(append_arrow(chosen, [("unit", T.BinaryType())], make, ["vec_id"]), "units")
    nodes = (
        rows.where("unit is not null")
        .groupBy("unit")
        .agg(F.count("*").alias("copies"), F.min("vec_id").alias("least"))
        .withColumn("node", F.monotonically_increasing_id())
    )
    return rows, write_once(nodes, "nodes"), length


def fit_centroids(x: np.ndarray, count: int, steps: int = 6, seed: int = 11) -> np.ndarray:
    """Centroids of unit vectors by spherical k-means."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), count, replace=False)].copy()
    for _ in range(steps):
        own = np.concatenate([(x[a : a + 4096] @ centres.T).argmax(1) for a in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        sizes = np.linalg.norm(sums, axis=1)
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1e-300)[:, None], centres)
    return centres


def dense_groups(centres: np.ndarray, cut: float) -> np.ndarray:
    """The shard of every centroid: those within the radius of one with many such share its shard.

    Otherwise a group of near copies with more centroids than a node has shards would lose pairs.
    """
    near = centres @ centres.T >= cut
    np.fill_diagonal(near, True)
    shard, count = np.full(len(centres), -1), 0
    for c in np.argsort(-near.sum(1), kind="stable"):
        if shard[c] < 0:
            shard[near[c] & (shard < 0)] = count
            count += 1
    return shard


def _centroids(nodes: DataFrame, n: int, length: int) -> np.ndarray:
    count = min(CENTROIDS, -(-n // SHARD))
    sample = nodes.select("node", "unit").orderBy(F.xxhash64("unit"), "node")
    units = sample.limit(min(SAMPLE, 32 * count)).select("unit").toPandas()["unit"]
    x = np.frombuffer(b"".join(units), np.float64).reshape(-1, length)
    return fit_centroids(x, min(count, len(x)))


def _shards(centres: np.ndarray, cut: float) -> tuple[np.ndarray, np.ndarray]:
    """The centroids in the order of their shards, and where each shard's begin."""
    shard = dense_groups(centres, cut)
    order = np.argsort(shard, kind="stable")
    return centres[order], np.searchsorted(shard[order], np.arange(shard.max() + 1))


def nearest_shards(x: np.ndarray, centres: np.ndarray, first: np.ndarray, most: int) -> np.ndarray:
    """The shards of the centroids most similar to each vector, the best first."""
    best = np.maximum.reduceat(x @ centres.T, first, axis=1)
    return np.argsort(-best, axis=1, kind="stable")[:, : min(most, len(first))]


def meeting_ranks(
    queries: np.ndarray, own: np.ndarray, x: np.ndarray, near: np.ndarray, hits: np.ndarray, shards: int
) -> np.ndarray:
    """For every query the number of vectors in range that meet it in a shard once both lie in their
    1, 2, ... nearest ones; the last column counts those that never do."""
    width = near.shape[1]
    out = np.zeros((len(queries), width + 1), np.int64)
    for k in range(len(queries)):
        rank = np.full(shards, width)
        rank[own[k]] = np.arange(own.shape[1])
        at = np.flatnonzero(hits[:, k])
        for a in range(0, len(at), TILE):
            both = np.maximum(rank[near[at[a : a + TILE]]], np.arange(width))
            out[k] += np.bincount(both.min(axis=1), minlength=width + 1)
    return out


def overlap_needed(nodes: DataFrame, centres: np.ndarray, first: np.ndarray, length: int, cut: float) -> int:
    """How many shards a node needs so that its pairs meet: the audit of the shards.

    A bounded number of nodes is compared with all nodes. The smallest overlap is taken at which the
    wanted share of their pairs meets, counted over all pairs, as the mean over the audited nodes, and
    as the mean over those of them with neighbours outside the nearest shard;
    ``ValueError`` where not even the least share can be reached.
    """
    picked = nodes.select("node", "unit").orderBy(F.xxhash64("unit"), "node").limit(AUDITED).collect()
    queries = _matrix([r["unit"] for r in picked], length)
    ids = np.array([r["node"] for r in picked], np.int64)
    shared = nodes.sparkSession.sparkContext.broadcast((queries, ids, centres, first))
    names = ["query", "rank", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, ids, centres, first = shared.value
        own = nearest_shards(queries, centres, first, MOST_SHARDS)
        total = np.zeros((len(queries), own.shape[1] + 1), np.int64)
        for batch in batches:
            x = _matrix(batch.column(1).to_pylist(), length)
            near = nearest_shards(x, centres, first, MOST_SHARDS)
            hits = x @ queries.T >= cut
            hits &= batch.column(0).to_numpy()[:, None] != ids
            total += meeting_ranks(queries, own, x, near, hits, len(first))
        q, rank = np.nonzero(total)
        columns = [pa.array(c, pa.int64()) for c in (q, rank, total[q, rank])]
        yield pa.RecordBatch.from_arrays(columns, names=names)

    counted = nodes.select("node", "unit").mapInArrow(run, "query long, rank long, n long")
    rows = counted.groupBy("query", "rank").agg(F.sum("n").alias("n")).collect()  # a few for each audited node
    width = min(MOST_SHARDS, len(first))
    met = np.zeros((len(picked), width + 1))
    for r in rows:
        met[r["query"], r["rank"]] = r["n"]
    met = met[met.sum(axis=1) > 0]
    if not len(met):
        return min(OVERLAP, width)
    so_far = np.cumsum(met, axis=1)[:, :width]
    of_node = so_far / met.sum(axis=1, keepdims=True)
    share = np.minimum(so_far.sum(axis=0) / met.sum(), of_node.mean(axis=0))
    if share[-1] < LEAST:
        raise ValueError(f"only {share[-1]:.2f} of the audited pairs meet in {width} shards")
    apart = of_node[of_node[:, 0] < 1]  # a dense group, whose nodes all meet at once, hides no others
    enough = np.flatnonzero(np.minimum(share, apart.mean(axis=0) if len(apart) else 1.0) >= WANTED)
    return max(min(OVERLAP, width), int(enough[0]) + 1 if len(enough) else width)


def _assigned(nodes: DataFrame, centres: np.ndarray, length: int, cut: float) -> DataFrame:
    """All nodes with their shards in order."""
    centres, first = _shards(centres, cut)
    overlap = overlap_needed(nodes, centres, first, length, cut)
    shared = nodes.sparkSession.sparkContext.broadcast((centres, first))

    def make():
        def work(batch: pa.RecordBatch) -> list[pa.Array]:
            units = batch.column(batch.schema.get_field_index("unit")).to_pylist()
            own = nearest_shards(_matrix(units, length), *shared.value, overlap)
            return [pa.array(np.sort(own, axis=1).tolist(), pa.list_(pa.int32()))]

        return work

    kind = T.ArrayType(T.IntegerType())
    return append_arrow(nodes.select("node", "unit", "copies"), [("shards", kind)], make)


def prune(x: np.ndarray, sims: np.ndarray, near: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """Neighbours of every node out of its candidates (by falling similarity); -1 fills up."""
    n, width = near.shape
    rows = np.arange(n)
    own = sims[rows[:, None], near]
    alive = near != rows[:, None]
    out = np.full((n, degree), -1, np.int32)
    for k in range(degree):
        left = alive.any(1)
        if not left.any():
            break
        pick = near[rows, alive.argmax(1)]
        out[left, k] = pick[left]
        closer = ALPHA * (1 - sims[pick[:, None], near]) <= 1 - own
        alive &= ~closer & (near != pick[:, None])
    return out


def build(x: np.ndarray, seed: int = 5) -> list[list[int]]:
    """A pruned graph over unit vectors, edges in both directions."""
    n = len(x)
    if n < 2:
        return [[] for _ in range(n)]
    rng = np.random.default_rng(seed)
    sims = x @ x.T
    np.fill_diagonal(sims, 2.0)
    k = min(n, NEAR + 1)
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    np.fill_diagonal(sims, 1.0)
    near = np.concatenate([near, rng.integers(0, n, (n, FAR))], axis=1)
    order = np.argsort(-sims[np.arange(n)[:, None], near], axis=1, kind="stable")
    out = prune(x, sims, np.take_along_axis(near, order, 1))
    a, k = np.nonzero(out >= 0)
    b = out[a, k]
    codes = np.unique(np.concatenate([a * n + b, b.astype(np.int64) * n + a]))
    return [c.tolist() for c in np.split(codes % n, np.searchsorted(codes // n, np.arange(1, n)))]


def search(queries: np.ndarray, x: np.ndarray, graph: np.ndarray, cut: float = CUT):
    """Places of queries and nodes in range, by beam search from the medoid and range expansion.

    ``graph`` holds neighbours of every node of ``x``, filled up with -1.
    """
    n, found = len(x), []
    medoid = int((x @ x.mean(0)).argmax())
    beam = min(BEAM, n)
    for first in range(0, len(queries), QUERIES):
        q = queries[first : first + QUERIES]
        m, rows = len(q), np.arange(len(q))
        seen = np.zeros((m, n + 1), bool)
        seen[:, n] = True  # place n stands for no neighbour
        seen[:, medoid] = True
        ids = np.full((m, beam), n, np.int64)
        best = np.full((m, beam), -2.0)
        done = np.ones((m, beam), bool)
        ids[:, 0], best[:, 0], done[:, 0] = medoid, q @ x[medoid], False
        near_q, near_i = [], []
        while True:
            open_ = np.where(done, -3.0, best)
            pick = open_.argmax(1)
            go = open_[rows, pick] > -3.0
            if not go.any():
                break
            act = rows[go]
            done[act, pick[go]] = True
            step = graph[ids[act, pick[go]]]
            step = np.where(step < 0, n, step)
            fresh = ~seen[act[:, None], step]
            a, c = np.nonzero(fresh)
            nodes = step[a, c]
            seen[act[a], nodes] = True
            sims = np.einsum("ij,ij->i", q[act[a]], x[nodes])
            near = sims >= cut - SLACK
            near_q.append(act[a[near]])
            near_i.append(nodes[near])
            new_s = np.full(step.shape, -2.0)
            new_s[a, c] = sims
            new_i = np.where(fresh, step, n)
            all_s = np.concatenate([best[act], new_s], 1)
            all_i = np.concatenate([ids[act], new_i], 1)
            all_d = np.concatenate([done[act], ~fresh], 1)
            top = np.argpartition(-all_s, beam - 1, axis=1)[:, :beam]
            best[act] = np.take_along_axis(all_s, top, 1)
            ids[act] = np.take_along_axis(all_i, top, 1)
            done[act] = np.take_along_axis(all_d, top, 1)
        start = q @ x[medoid] >= cut - SLACK
        wave_q = np.concatenate([rows[start], *near_q])
        wave_i = np.concatenate([np.full(start.sum(), medoid), *near_i]).astype(np.int64)
        while len(wave_q):  # range expansion
            sims = np.einsum("ij,ij->i", q[wave_q], x[wave_i])
            hit = sims >= cut
            found.append((wave_q[hit] + first, wave_i[hit]))
            step = graph[wave_i]
            k, c = np.nonzero(step >= 0)
            codes = wave_q[k] * (n + 1) + step[k, c]
            codes = np.unique(codes[~seen[wave_q[k], step[k, c]]])
            wave_q, wave_i = codes // (n + 1), codes % (n + 1)
            seen[wave_q, wave_i] = True
            near = np.einsum("ij,ij->i", q[wave_q], x[wave_i]) >= cut - SLACK
            wave_q, wave_i = wave_q[near], wave_i[near]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _matrix(units: list[bytes], length: int) -> np.ndarray:
    return np.frombuffer(b"".join(units), np.float64).reshape(-1, length)


def _build_part(length: int):
    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by("node")
        nodes = part.column("node").to_numpy()
        graph = build(_matrix(part.column("unit").to_pylist(), length))
        return pa.table(
            {
                "node": pa.array(nodes, pa.int64()),
                "near": pa.array([nodes[g].tolist() for g in graph], pa.list_(pa.int64())),
            }
        )

    return run


def _local_graph(nodes: np.ndarray, near: list[list[int]]) -> np.ndarray:
    """Adjacency by place for the nodes of a part, from lists that also name other nodes."""
    sizes = np.array([len(g) for g in near], np.int64)
    flat = np.array([v for g in near for v in g], np.int64)
    owner = np.repeat(np.arange(len(nodes)), sizes)
    place = np.searchsorted(nodes, flat)
    place[place == len(nodes)] = 0
    ok = nodes[place] == flat if len(flat) else np.zeros(0, bool)
    owner, place = owner[ok], place[ok]
    counts = np.bincount(owner, minlength=len(nodes))
    out = np.full((len(nodes), max(1, int(counts.max(initial=0)))), -1, np.int64)
    column = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    out[owner, column] = place
    return out


def _search_parts(length: int, cut: float):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        shard, one, two = (k.as_py() for k in key)
        rows = rows.sort_by("node")
        sides = []
        for part in dict.fromkeys((one, two)):
            own = rows.filter(pc.equal(rows.column("part"), part))
            nodes = own.column("node").to_numpy()
            near = own.column("near").to_pylist()
            sides.append(
                {
                    "nodes": nodes,
                    "x": _matrix(own.column("unit").to_pylist(), length),
                    "graph": _local_graph(nodes, near) if len(nodes) else None,
                    "copies": own.column("copies").to_numpy(),
                    "shards": np.array(own.column("shards").to_pylist(), np.int64).reshape(len(nodes), -1),
                }
            )
        a, b = sides[0], sides[-1]
        n = len(b["nodes"])
        codes = np.empty(0, np.int64)
        if len(a["nodes"]) and n:
            q, i = search(a["x"], b["x"], b["graph"], cut)
            if one == two:
                q, i = np.minimum(q, i), np.maximum(q, i)
                codes = np.unique(q[q < i] * n + i[q < i])
            else:
                i2, q2 = search(b["x"], a["x"], a["graph"], cut)
                codes = np.unique(np.concatenate([q * n + i, q2 * n + i2]))
        q, i = codes // n if n else codes, codes % n if n else codes
        if len(q):  # a pair counts in the first shard that both are in
            common = (a["shards"][q][:, :, None] == b["shards"][i][:, None, :]).any(2)
            first = np.where(common, a["shards"][q], np.iinfo(np.int64).max).min(1)
            q, i = q[first == shard], i[first == shard]
        counts_a = np.bincount(q, b["copies"][i], len(a["nodes"])).astype(np.int64)
        counts_b = np.bincount(i, a["copies"][q], n).astype(np.int64)
        shift = 0 if one == two else len(a["nodes"])
        both = a["nodes"] if one == two else np.concatenate([a["nodes"], b["nodes"]])
        fa, fb = forest(q, i + shift, len(both))
        ends = np.concatenate([a["nodes"][counts_a > 0], b["nodes"][counts_b > 0]])
        links = np.concatenate([counts_a[counts_a > 0], counts_b[counts_b > 0]])
        return pa.table(
            {
                "a": pa.array(np.concatenate([both[fa], ends]), pa.int64()),
                "b": pa.array(both[fb].tolist() + [None] * len(ends), pa.int64()),
                "links": pa.array(np.concatenate([np.zeros(len(fa), np.int64), links]), pa.int64()),
            }
        )

    return run


def link(vectors: DataFrame, cut: float = CUT) -> DataFrame:
    """``vec_id``, ``n_links``, ``component_id`` and ``kept`` of every vector."""
    rows, nodes, length = _nodes(vectors)
    n = nodes.count()
    if n:
        placed = _assigned(nodes, _centroids(nodes, n, length), length, cut)
        placed = placed.select("node", "unit", "copies", "shards", F.explode("shards").alias("shard"))
        sizes = placed.groupBy("shard").agg((F.floor((F.count("*") - 1) / PART) + 1).alias("parts"))
        sizes = F.broadcast(write_once(sizes, "shard-sizes"))  # at most CENTROIDS rows
        placed = placed.join(sizes, "shard").withColumn(
            "part", F.pmod(F.xxhash64("node"), F.col("parts"))
        )
        placed = write_once(placed, "shards")
        built = placed.select("shard", "part", "node", "unit").groupBy("shard", "part")
        graph = built.applyInArrow(_build_part(length), "node long, near array<long>")
        united = graph.groupBy("node").agg(
            F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")
        )
        tasks = placed.join(write_once(united, "graph"), "node").withColumn(
            "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
        )
        tasks = tasks.withColumn("one", F.least("part", "other")).withColumn(
            "two", F.greatest("part", "other")
        )
        out = tasks.groupBy("shard", "one", "two").applyInArrow(
            _search_parts(length, cut), "a long, b long, links long"
        )
        out = write_once(out, "vector-links")
        roots = components(out.where("b is not null").select("a", "b"))
        counts = out.where("b is null").groupBy("a").agg(F.sum("links").alias("links"))
        known = nodes.join(roots, "node", "left").join(counts.withColumnRenamed("a", "node"), "node", "left")
        known = known.withColumn("root", F.coalesce("root", "node"))
        names = known.groupBy("root").agg(F.min("least").alias("component_id"))
        known = known.join(names, "root").select(
            "unit", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"
        )
    else:
        known = nodes.select("unit", F.col("copies").alias("n_links"), F.col("least").alias("component_id"))
    lone = F.col("unit").isNull()
    component = F.when(lone, F.col("vec_id")).otherwise(F.col("component_id"))
    return rows.join(known, "unit", "left").select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def recall(vectors: DataFrame, linked: DataFrame, cut: float = CUT) -> DataFrame:
    """``expected`` and ``found`` links of every vector whose id is divisible by 100.

    The queries go, in blocks of a thousand, over all rows.
    """
    rows, _, length = _nodes(vectors)
    asked = rows.where("vec_id % 100 = 0 and unit is not null")
    block = F.floor(F.col("vec_id") / 100_000)
    asked = asked.groupBy(block.alias("block")).agg(F.collect_list(F.struct("vec_id", "unit")).alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for queries, units in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                q = _matrix([x["unit"] for x in queries], length)
                hits = (_matrix(units, length) @ q.T >= cut).sum(0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["vec_id"] for x in queries], pa.int64()), pa.array(hits, pa.int64())],
                    names=["vec_id", "hits"],
                )

    count = rows.count() // TILE + 1
    dealt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(count)).alias("tile")
    tiles = (
        rows.where("unit is not null")
        .groupBy(dealt)
        .agg(F.collect_list("unit").alias("units"))
    )
    every = F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))
    pairs = asked.withColumn("tile", F.explode(every))
    hits = pairs.join(tiles, "tile").select("q", "units").mapInArrow(run, "vec_id long, hits long")
    expected = hits.groupBy("vec_id").agg((F.sum("hits") - 1).alias("expected"))
    return expected.join(linked.select("vec_id", F.col("n_links").alias("found")), "vec_id")
