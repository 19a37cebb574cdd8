"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors get one more component that makes all norms equal, so that the largest inner product is the
smallest distance. Centroids are fitted on a bounded sample and kept in balance by splitting
crowded ones; every vector is put on the list of its nearest centroid and, near a border, on
further ones. A query finds centroids by walking an in-memory graph of them and reads the lists
whose distance is within a ratio of the nearest one's, or of the one that makes the candidates
enough where the nearest hold too few. Lists are joined with the queries that read
them in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkwick.llm.common import stage
from sparkwick.llm.vectors import dimension, lists, matrix, usable

#: Half the root of the number of vectors is the number of lists, up to so many; sampled vectors
#: per list.
LISTS, SAMPLE = 4096, 32
#: A vector joins further lists up to this ratio of the nearest distance, and this many lists.
BORDER, COPIES = 1.15, 4
#: A query reads lists up to this ratio of the nearest distance, at most this share of all lists
#: (but always this many): where vectors have no structure, a recall of 0.9 needs about that.
RATIO, SHARE, PROBES = 1.5, 0.2, 12
#: Neighbours of a centroid in the graph.
DEGREE = 16
#: Vectors and queries of a block at most.
BLOCK_VECTORS, BLOCK_QUERIES = 2_048, 4_096


def fit_centroids(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """k-means whose clusters hold at most about twice the mean: crowded ones are split."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for step in range(rounds):
        near = _nearest(x, c)
        size = np.bincount(near, minlength=len(c))
        for j in np.flatnonzero(size):
            c[j] = x[near == j].mean(axis=0)
        empty = np.flatnonzero(size == 0)
        crowded = np.argsort(-size, kind="stable")[: len(c) // 8 + 1]
        crowded = crowded[size[crowded] > 2 * len(x) / len(c)]
        if step == rounds - 1:
            break
        spare = np.concatenate([empty, np.argsort(size, kind="stable")])[: len(crowded)]
        for j, s in zip(crowded, spare, strict=False):  # the emptiest help the fullest
            if size[s] * 4 < size[j]:
                c[s] = x[rng.choice(np.flatnonzero(near == j))]
    return c[np.bincount(_nearest(x, c), minlength=len(c)) > 0]


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = (c * c).sum(axis=1) / 2
    parts = [np.argmax(x[i : i + 4096] @ c.T - half, axis=1) for i in range(0, len(x), 4096)]
    return np.concatenate(parts) if parts else np.zeros(0, dtype=np.int64)


class Graph:
    """Nearest-neighbour graph over centroids, with a few far links so that it holds together."""

    def __init__(self, c: np.ndarray, seed: int = 11):
        self.c = c
        n = len(c)
        degree = min(DEGREE, n - 1)
        links = []
        for i in range(0, n, 1024):
            part = c[i : i + 1024]
            d = -2 * part @ c.T + (c * c).sum(axis=1)
            d[np.arange(len(part)), i + np.arange(len(part))] = np.inf
            links.append(np.argsort(d, axis=1, kind="stable")[:, :degree])
        near = np.concatenate(links) if n > 1 else np.zeros((n, 0), dtype=np.int64)
        far = np.random.default_rng(seed).integers(0, n, (n, 4))
        self.links = np.concatenate([near, far], axis=1)
        self.entry = np.unique(np.linspace(0, n - 1, min(n, 8)).astype(np.int64))

    def search(self, q: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
        """Per row of ``q`` the centroids that a best-first walk finds, nearest first, with their
        distances; -1 fills rows that found fewer."""
        n, m = len(q), len(self.c)
        keep = min(max(keep, len(self.entry)), m)
        ids = np.full((n, keep), -1, dtype=np.int64)
        dist = np.full((n, keep), np.inf)
        ids[:, : len(self.entry)] = self.entry
        dist[:, : len(self.entry)] = self._distance(q, np.broadcast_to(self.entry, (n, len(self.entry))))
        done = np.zeros((n, m), dtype=bool)
        rows = np.arange(n)
        while len(rows):
            open_ = np.where((ids[rows] >= 0) & ~done[rows[:, None], ids[rows]], dist[rows], np.inf)
            best = np.argmin(open_, axis=1)
            going = np.isfinite(open_[np.arange(len(rows)), best])
            rows, best = rows[going], best[going]
            if not len(rows):
                break
            node = ids[rows, best]
            done[rows, node] = True
            new = self.links[node]
            all_ids = np.concatenate([ids[rows], new], axis=1)
            all_dist = np.concatenate([dist[rows], self._distance(q[rows], new)], axis=1)
            order = np.argsort(all_ids, axis=1, kind="stable")  # drop what is there twice
            sorted_ids = np.take_along_axis(all_ids, order, axis=1)
            twice = np.zeros_like(sorted_ids, dtype=bool)
            twice[:, 1:] = sorted_ids[:, 1:] == sorted_ids[:, :-1]
            np.put_along_axis(all_dist, order, np.where(
                twice, np.inf, np.take_along_axis(all_dist, order, axis=1)), axis=1)
            pick = np.argsort(all_dist, axis=1, kind="stable")[:, :keep]
            dist[rows] = np.take_along_axis(all_dist, pick, axis=1)
            ids[rows] = np.where(
                np.isfinite(dist[rows]), np.take_along_axis(all_ids, pick, axis=1), -1
            )
        return ids, np.sqrt(np.maximum(dist, 0))

    def _distance(self, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
        c = self.c[ids]
        return np.einsum("nkd,nkd->nk", q[:, None, :] - c, q[:, None, :] - c)


def home_lists(x: np.ndarray, graph: Graph) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, list, whether it is the nearest): that list of every row and those hardly farther."""
    ids, dist = graph.search(x, 16)
    ids, dist = ids[:, :COPIES], dist[:, :COPIES]
    row, col = np.nonzero((ids >= 0) & (dist <= BORDER * dist[:, :1]))
    return row, ids[row, col], col == 0


def probed_lists(
    q: np.ndarray, graph: Graph, held: np.ndarray, least: int
) -> tuple[np.ndarray, np.ndarray]:
    """(row, list) pairs: the lists that every row reads.

    ``held`` has the ids whose nearest list each is. Where the lists within ``RATIO`` of the nearest
    hold fewer than ``least`` ids, the ratio counts from the list that makes them enough, so that
    all are read if there are not as many.
    """
    most = max(PROBES, int(SHARE * len(graph.c)))
    ids, dist = graph.search(q, most + 16)
    ids, dist = ids[:, :most], dist[:, :most]
    row, col = np.nonzero((ids >= 0) & (dist <= RATIO * dist[:, :1]))
    where = ids[row, col]
    few = np.bincount(row, held[where], minlength=len(q)) < least
    if not few.any():
        return row, where
    d = -2 * q[few] @ graph.c.T + (graph.c * graph.c).sum(axis=1) + (q[few] ** 2).sum(axis=1)[:, None]
    order = np.argsort(d, axis=1, kind="stable")
    d = np.sqrt(np.maximum(np.take_along_axis(d, order, axis=1), 0))
    count = np.cumsum(held[order], axis=1)
    last = np.minimum((count < least).sum(axis=1), d.shape[1] - 1)[:, None]
    place = np.arange(d.shape[1])
    reads = (d <= RATIO * np.take_along_axis(d, last, axis=1)) & (place < most) | (place <= last)
    more, at = np.nonzero(reads)
    kept = ~few[row]
    return (
        np.concatenate([row[kept], np.flatnonzero(few)[more]]),
        np.concatenate([where[kept], order[more, at]]),
    )


def search(
    df: DataFrame, is_query, top: int = 20, vec_id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """The ``top`` nearest other rows of each query row: query_id, rank, vec_id, score.

    ``is_query`` is a condition on ``df``. Nearness is the inner product in double precision,
    ties go to the smaller id. Rows with a null id, or with a vector that is null, zero, of
    another length than most, or with a null or infinite component take no part. Rows with equal
    vectors are searched once; of their ids the ``top`` + 1 smallest can be among the nearest, so
    no more are kept. Repeated rows with the same id count as one. A query with fewer candidates
    gets all. Other columns of ``df`` are not used.
    """
    spark = df.sparkSession
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = dimension(df, vector)
    rows = df.where(usable(vector) & F.col(vec_id).isNotNull() & (F.size(vector) == dims))
    rows = rows.select(
        F.col(vec_id).cast("long").alias("id"),
        F.col(vector).cast("array<double>").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("q"),
    )
    if not dims:
        return none
    # equal vectors: one entry with its smallest ids
    rows = rows.withColumn("h", F.xxhash64("v"))
    by_id = Window.partitionBy("h", "v").orderBy("id")
    some = rows.dropDuplicates(["id", "h", "v"]).withColumn("r", F.row_number().over(by_id))
    some = some.where(F.col("r") <= top + 1)
    entries = some.groupBy("h", "v").agg(
        F.min("id").alias("uid"), F.sort_array(F.collect_list("id")).alias("ids")
    )
    entries = stage(entries.select("uid", "ids", "v"), "entries")
    queries = stage(rows.where("q").select("id", "h", "v").dropDuplicates(["id", "h", "v"]), "asked")

    n = entries.count()
    if not n:
        return none
    k = int(min(LISTS, max(1, round(n**0.5 / 2))))
    share = min(1.0, 1.2 * SAMPLE * k / n)
    picked = F.pmod(F.xxhash64("uid"), F.lit(1 << 20)) < int(share * (1 << 20)) + 1
    sample = entries.where(picked).select("uid", "v").limit(SAMPLE * k * 2).toArrow()
    sample = sample.sort_by("uid").combine_chunks()
    x = matrix(sample.column("v").combine_chunks(), dims)
    norm = entries.select(F.max(F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e))).first()[0]

    def lifted(v: np.ndarray) -> np.ndarray:
        rest = np.maximum(norm - (v * v).sum(axis=1), 0)
        return np.concatenate([v, np.sqrt(rest)[:, None]], axis=1)

    centroids = fit_centroids(lifted(x), k)
    shared = spark.sparkContext.broadcast(centroids)  # at most LISTS rows

    def to_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = Graph(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                v = matrix(part.column(1), dims)
                row, where, home = home_lists(lifted(v), graph)
                ids = part.column(2).to_numpy(zero_copy_only=False)[row].astype(np.int64) * home
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where), part.column(0).take(pa.array(row)), lists(v[row]),
                     pa.array(ids)],
                    names=["list", "uid", "v", "held"],
                )

    def to_probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        graph = Graph(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                v = matrix(part.column(1), dims)
                # the length of a query does not matter: give it the length of the lifted vectors
                q = v * (np.sqrt(norm) / np.sqrt((v * v).sum(axis=1)))[:, None]
                q = np.pad(q, ((0, 0), (0, 1)))
                row, where = probed_lists(q, graph, held.value, top + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(where), part.column(0).take(pa.array(row)), lists(v[row])],
                    names=["list", "uid", "v"],
                )

    shape = "list long, uid long, v array<double>"
    posted = entries.select("uid", "v", F.size("ids").alias("n"))
    posted = stage(posted.mapInArrow(to_lists, f"{shape}, held long"), "lists")
    counts = np.zeros(len(centroids), dtype=np.int64)
    for r in posted.groupBy("list").agg(F.sum("held")).collect():  # at most LISTS rows
        counts[r[0]] = r[1]
    held = spark.sparkContext.broadcast(counts)
    different = queries.groupBy("h", "v").agg(F.min("id").alias("uid"))
    different = stage(different.select("uid", "h", "v"), "different")
    probes = stage(different.select("uid", "v").mapInArrow(to_probes, shape), "probes")

    # blocks of bounded size: a list's vectors in s parts, its queries in t parts
    sizes = posted.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_VECTORS).alias("s"))
    asks = probes.groupBy("list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).alias("t"))
    blocks = F.broadcast(sizes.join(asks, "list"))  # at most LISTS rows
    part = lambda name: F.pmod(F.xxhash64("uid"), F.col(name))
    every = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name) - 1))
    left = posted.join(blocks, "list").select(
        "list", part("s").alias("i"), every("t").alias("j"), F.lit(False).alias("q"), "uid", "v"
    )
    right = probes.join(blocks, "list").select(
        "list", every("s").alias("i"), part("t").alias("j"), F.lit(True).alias("q"), "uid", "v"
    )

    def best(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        is_q = table.column("q").to_numpy().astype(bool)
        uid = table.column("uid").to_numpy()
        v = matrix(table.column("v").combine_chunks(), dims)
        order = np.flatnonzero(~is_q)[np.argsort(uid[~is_q], kind="stable")]
        own, theirs = uid[order], v[order]
        out = [[], [], []]
        for at in range(0, int(is_q.sum()), 512):
            q = np.flatnonzero(is_q)[at : at + 512]
            score = v[q] @ theirs.T
            pick = np.argsort(-score, axis=1, kind="stable")[:, : top + 1]
            out[0].append(np.repeat(uid[q], pick.shape[1]))
            out[1].append(own[pick].ravel())
            out[2].append(np.take_along_axis(score, pick, axis=1).ravel())
        cols = [np.concatenate(c) if c else np.zeros(0) for c in out]
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        return pa.Table.from_arrays(
            [pa.array(c, k, from_pandas=False) for c, k in zip(cols, kinds, strict=True)],
            names=["asker", "uid", "score"],
        )

    found = left.union(right).groupBy("list", "i", "j").applyInArrow(
        best, "asker long, uid long, score double"
    )
    found = found.groupBy("asker", "uid").agg(F.max("score").alias("score"))
    nearest = Window.partitionBy("asker").orderBy(F.desc("score"), "uid")
    found = found.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= top + 1)
    found = found.join(entries.select("uid", "ids"), "uid").select(
        "asker", "score", F.explode("ids").alias("vec_id")
    )
    nearest = Window.partitionBy("asker").orderBy(F.desc("score"), "vec_id")
    found = stage(
        found.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= top + 1), "nearest"
    )
    # back to query rows: their vector's result without themselves
    answers = queries.join(different.withColumnRenamed("uid", "asker"), ["h", "v"])
    answers = answers.select(F.col("id").alias("query_id"), "asker").join(found, "asker")
    answers = answers.where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    answers = answers.withColumn("rank", rank).where(F.col("rank") <= top)
    return answers.select("query_id", "rank", "vec_id", "score")
